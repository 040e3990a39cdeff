"""Text expressions for retrieval: paragraphs, tokens, passages, sentences and guards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from visitframe.scaling import col

# Stop words, section names that are left out, and the pattern of advice requests.
STOP_WORDS = ("the a an of and or to in for with on by is are was were be been as at from that this it its their which what "
              "does do how can could should would i my me we you your about into than then there these those has have had").split()
SKIP_SECTIONS = r"(?i)reference|acknowledg|funding|conflict|contributor|declaration|supplement|author|disclosure|data sharing"
ADVICE = (r"(?i)\b(should (i|he|she|we|my|the patient|this patient)|what (drug|medication|medicine|dose|dosage|treatment)s? (should|do i|to give|is best for (me|him|her|my|this))"
          r"|prescribe|how (much|many mg)|\bdos(e|age|ing)\b|can i (take|stop|start)|stop taking|start taking|"
          r"(treat|treatment plan|medication) for (my|this|the) (patient|mother|father|husband|wife|mom|dad)|is it safe (for|to))")
WORDS_PER_PASSAGE = 180
MIN_PARAGRAPH_WORDS = 25
MIN_SIMILARITY = 0.35
SCORE_DIGITS = 9      # scores are rounded before ranking, so equal texts tie whatever the summation order
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z])"
SPACE = r"[ \t\r\n\f]+"


def let(value: Column, body) -> Column:
    """Evaluate a costly expression once per row and use it many times (a lambda body is evaluated per element)."""
    return F.transform(F.array(value), body)[0]


def words(c: str | Column) -> Column:
    return F.split(col(c), " ")


def normalise(c: str | Column) -> Column:
    return F.trim(F.regexp_replace(col(c), SPACE, " "))


def paragraph_array(text: str | Column, heading: Column, min_words: int = MIN_PARAGRAPH_WORDS) -> Column:
    """Ordered (heading, text) of a document's paragraphs: bracketed citations out, short ones out, skipped sections empty."""
    parts = F.transform(F.split(col(text), "\n"), lambda p: F.regexp_replace(normalise(p), r"\[[\d,\s\-–]+\]", ""))
    long = F.filter(parts, lambda p: F.size(F.filter(words(p), lambda w: w != "")) >= min_words)
    kept = let(heading, lambda h: F.transform(long, lambda p: F.struct(h.alias("heading"), p.alias("text"))))
    return F.when(~F.coalesce(heading, F.lit("")).rlike(SKIP_SECTIONS), kept).otherwise(F.slice(kept, 1, 0))


def passage_array(paragraphs: Column, size: int = WORDS_PER_PASSAGE) -> Column:
    """Pack ordered paragraphs into passages inside the row.

    Paragraphs of one heading are joined up to 1.5 × size words; a longer
    paragraph is first cut every `size` words.
    """
    limit = int(size * 1.5)

    def pieces(p: Column) -> Column:
        w = F.filter(words(p["text"]), lambda x: x != "")
        n = F.size(w)
        cuts = F.greatest(F.ceil((n - limit) / F.lit(float(size))), F.lit(0)).cast("int")
        return F.transform(F.sequence(F.lit(0), cuts), lambda i: F.struct(
            p["heading"].alias("heading"), F.array_join(F.when(i < cuts, F.slice(w, i * size + 1, size)).otherwise(F.slice(w, i * size + 1, F.greatest(n, F.lit(1)))), " ").alias("text"),
            (i == 0).alias("first"), (i < cuts).alias("cut"), n.alias("whole"), F.when(i < cuts, F.lit(size)).otherwise(n - cuts * size).alias("n")))

    parts = F.flatten(F.transform(paragraphs, pieces))
    item = "struct<heading:string,text:string>"
    start = F.struct(F.array().cast(f"array<{item}>").alias("out"), F.lit(None).cast("string").alias("head"),
                     F.array().cast("array<string>").alias("buf"), F.lit(0).alias("n"))

    def flushed(s: Column, buf: Column, head: Column) -> Column:
        row = F.struct(F.coalesce(head, F.lit("")).alias("heading"), F.array_join(buf, " ").alias("text"))
        return F.when(F.size(buf) > 0, F.concat(s["out"], F.array(row))).otherwise(s["out"])

    def step(s: Column, p: Column) -> Column:
        full = p["first"] & (~p["heading"].eqNullSafe(s["head"]) | (s["n"] + p["whole"] > limit))
        out1 = F.when(full, flushed(s, s["buf"], s["head"])).otherwise(s["out"])
        empty = F.slice(s["buf"], 1, 0)
        buf = F.concat(F.when(full, empty).otherwise(s["buf"]), F.array(p["text"]))
        n = F.when(full, F.lit(0)).otherwise(s["n"]) + p["n"]
        head = F.when(full, p["heading"]).otherwise(s["head"])
        cut_row = F.struct(F.coalesce(head, F.lit("")).alias("heading"), F.array_join(buf, " ").alias("text"))
        return F.struct(F.when(p["cut"], F.concat(out1, F.array(cut_row))).otherwise(out1).alias("out"), head.alias("head"),
                        F.when(p["cut"], empty).otherwise(buf).alias("buf"), F.when(p["cut"], F.lit(0)).otherwise(n).cast("int").alias("n"))

    return F.aggregate(parts, start, step, lambda s: flushed(s, s["buf"], s["head"]))


def tokens(c: str | Column) -> Column:
    """Lower-case words and numbers of two or more characters, without stop words, repeats kept."""
    found = F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9]+)"), 1)
    return F.filter(found, lambda w: (F.length(w) > 1) & ~w.isin(STOP_WORDS))


def sentences(c: str | Column) -> Column:
    return F.split(col(c), SENTENCE_BREAK)


def is_advice(c: str | Column) -> Column:
    return col(c).rlike(ADVICE)


def cited(c: str | Column) -> Column:
    """Numbers cited in square brackets."""
    return F.transform(F.regexp_extract_all(col(c), F.lit(r"\[(\d+)\]"), 1), lambda x: x.try_cast("int"))


def citations_valid(c: str | Column, n_hits: int | Column) -> Column:
    """At least one citation, and all of them within the retrieved sources."""
    n = F.lit(n_hits) if isinstance(n_hits, int) else n_hits
    return (F.size(cited(c)) > 0) & F.forall(cited(c), lambda x: F.coalesce(x.between(1, n), F.lit(False)))


def cited_sources(c: str | Column) -> Column:
    return F.array_sort(F.array_distinct(cited(c)))


def letter_vector(c: str | Column) -> Column:
    """Unit-length histogram of the letters a-z: a small deterministic embedding for checks."""
    counts = let(F.lower(col(c)), lambda low: F.array(*[
        (F.length(low) - F.length(F.replace(low, F.lit(ch)))).cast("double") for ch in "abcdefghijklmnopqrstuvwxyz"]))
    return unit(counts)


def unit(v: Column) -> Column:
    both = let(v, lambda a: F.struct(a.alias("v"), F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x)).alias("norm")))
    return let(both, lambda b: F.transform(b["v"], lambda x: F.try_divide(x, b["norm"])))


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.round(F.aggregate(products, F.lit(0.0), lambda s, x: s + x), SCORE_DIGITS)
