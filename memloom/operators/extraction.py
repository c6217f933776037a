"""From message text to sentence passages and attribute facts, without a model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lexicon import speaker_of

#: Wording of a statement and the attribute it gives (None: the first group names it); the last group is the value.
#: Rules are data: pass others to ``attributes`` and ``extract``. The first that fits decides.
RULES = (
    ("current city", r"\bI (?:now )?(?:live|moved) (?:in|to)\s+([^.!?;,\n]+)"),
    ("current city", r"\bWe moved to\s+([^.!?;,\n]+)"),
    ("job title", r"\bI (?:now )?work as (?:an? )?([^.!?;,\n]+)"),
    ("employer", r"\bI (?:now )?work (?:at|for)\s+([^.!?;,\n]+)"),
    ("hobby", r"\bI (?:like|love|enjoy)\s+([^.!?;,\n]+)"),
    (None, r"\b[Mm]y (?:new |old |current )?([a-z]+(?: [a-z]+)?) (?:is|are)\s+([^.!?;,\n]+)"),
)
#: Attributes that may have several values at once.
SEVERAL = ("hobby", "favorite food", "pet")
TENTATIVE = r"(?i)\b(?:may|might|maybe|perhaps|plan|plans|planning|probably|not sure)\b"
#: Asking to remove something, and talking about it without asking.
FORGET = r"(?i)^(?:please |now |then )*(?:forget|delete|erase|remove|discard)\b"
DENIED = r"(?i)\b(?:not|never|don't|if|said|says|example)\b"
RESTORE = r"(?i)\b(?:remember|store|keep)\b.*\bagain\b"
ENDS = ".!?。！？;；\\n"
LONGEST, SHORTEST = 900, 450


def pieces(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, piece) of the sentences of a text; the pieces tile it, offsets are characters from 0.

    A sentence longer than ``LONGEST`` is cut at its last space after ``SHORTEST`` characters, or at ``LONGEST`` if there
    is none. Null and empty texts give none.
    """
    word, end = f"[^{ENDS}]", f"[{ENDS}]+\\s*"
    tile = rf"({word}{{1,{LONGEST}}}(?:{end}|\z)|{word}{{{SHORTEST},{LONGEST - 1}}} |{word}{{1,{LONGEST}}}|{end})"
    rows = df.select(F.col(id_col).alias("id"), F.regexp_extract_all(F.col(text), F.lit(tile), F.lit(1)).alias("s"))
    # running sums of the lengths, in one pass
    starts = F.aggregate("s", F.array(F.lit(0)), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(x))))
    rows = rows.select("id", F.explode(F.arrays_zip(F.slice(starts, 1, F.size("s")).alias("start"), F.col("s"))).alias("p"))
    return rows.select("id", F.col("p.start").alias("start"), F.col("p.s").alias("piece"))


def sentences(df: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, start, quote): ``pieces`` without surrounding white space; blank ones give none."""
    rows = pieces(df, id_col, text)
    return rows.select("id", "start", F.trim(F.regexp_replace("piece", r"[\n\s]+$", "")).alias("quote")).where("quote <> ''")


def intent_of(quote: Column) -> Column:
    """What a sentence asks of the memory: restore, forget, blocked (denied or reported) or none."""
    ask, talk = quote.rlike(FORGET), quote.rlike(DENIED) & quote.rlike(r"(?i)\b(?:forget|delete|erase|remove|discard)\b")
    return F.when(quote.rlike(RESTORE), "restore").when(ask & ~talk, "forget").when(talk, "blocked").otherwise("none")


def attributes(quote: Column, rules=RULES) -> Column:
    """struct(predicate, value): the attribute a sentence states (nulls if none)."""
    pred, value = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for name, wording in rules:
        hit = quote.rlike(wording)
        pred = pred.when(hit, F.regexp_extract(quote, wording, 1) if name is None else F.lit(name))
        value = value.when(hit, F.trim(F.regexp_extract(quote, wording, 2 if name is None else 1)))
    return F.struct(pred.alias("predicate"), value.alias("value"))


def extract(messages: DataFrame, id_col: str = "id", role: str = "role", text: str = "content", rules=RULES) -> DataFrame:
    """Attribute facts stated in the messages of users and named speakers.

    Columns: id (of source, place and attribute), source_id, start, quote, subject, predicate, value, kind, modality, cardinality.
    ``start`` counts in the text without session headers. Sentences that ask to forget or talk of it state nothing.
    """
    clean = F.trim(F.regexp_replace(F.col(text), r"\[Session time:[^\]]*\]", ""))
    m = messages.select(F.col(id_col).alias("mid"), F.lower(F.trim(F.col(role))).alias("role"), clean.alias("clean"))
    m = m.withColumn("name", speaker_of(F.col("clean"))).where((F.col("role") == "user") | F.col("name").isNotNull())
    who = F.struct(F.col("mid").alias("mid"), F.coalesce("name", "role").alias("subject"))
    s = sentences(m.withColumn("who", who), "who", "clean").where(intent_of(F.col("quote")) == "none")
    s = s.withColumn("a", attributes(F.col("quote"), rules)).where("a.predicate <> '' and a.value <> ''")
    several = F.col("a.predicate").isin(*SEVERAL)
    return s.select(
        F.sha2(F.concat_ws(chr(0), "id.mid", F.col("start").cast("string"), "a.predicate"), 256).alias("id"),
        F.col("id.mid").alias("source_id"), "start", "quote", F.col("id.subject").alias("subject"), "a.predicate", "a.value",
        F.when(several, "preference").otherwise("fact").alias("kind"),
        F.when(F.col("quote").rlike(TENTATIVE), "tentative").otherwise("confirmed").alias("modality"),
        F.when(several, "multiple").otherwise("single").alias("cardinality"),
    )
