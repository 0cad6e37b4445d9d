"""Operator 11: fill-in-middle transformation by lookaround splitting.

A unit grammar says between which neighbouring classes of characters a unit ends. It is translated to one zero-width regular
expression, a lookbehind of the class before and a lookahead of the class after for each pair, and Spark's split cuts the text
there without losing a character. The cut points are drawn from hashes of the document's id in units, and the three pieces are
put together in one of two orders. All of it is built-in functions: one pass, no shuffle.

A text is first cut into blocks that end at unit boundaries, and the units of one block at a time are counted and measured, so
the pieces of a very long text never stand in memory together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs of classes (before, after) between which a unit ends, as regular expressions of one character each.
GRAMMARS: dict[str, tuple[tuple[str, str], ...]] = {
    "code_point": ((".", "."),),
    "word": ((r"\s", r"\S"),),  # a word and the space after it
    "line": ((r"\n", "."),),
    "sentence": ((r"[.!?…。]", r"\s"),),  # the space belongs to the next sentence
    "run": ((r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"\s", r"\S"), (r"[^\p{L}\p{N}\s]", r"[\p{L}\p{N}\s]")),
}
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Shares in percent: documents that are not transformed, and those of the rest whose suffix comes first.
PLAIN_PERCENT = 10
SUFFIX_FIRST_PERCENT = 20
#: Characters from which on a block ends at the next unit boundary.
BLOCK = 512


def boundary(grammar: str) -> str:
    """The zero-width regular expression of a grammar's unit boundaries; it matches neither end of a text."""
    return "(?s)" + "|".join(f"(?<={before})(?={after})" for before, after in GRAMMARS[grammar])


def units(text: Column, grammar: str = "code_point") -> Column:
    """The units of a text in order, which joined give the text; none for the empty text, of which split would make one."""
    return F.when(F.length(text) == 0, F.array().cast("array<string>")).otherwise(F.split(text, boundary(grammar), -1))


def blocks(text: Column, grammar: str = "code_point", size: int = BLOCK) -> Column:
    """The text in blocks of at least ``size`` characters (but for the last) that end at the next unit boundary."""
    ends = boundary(grammar).removeprefix("(?s)")
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{size}}}.*?(?:{ends}|\z)|.+"), F.lit(0))


def _characters_before(text_blocks: Column, sizes: Column, cut: Column, grammar: str) -> Column:
    """How many characters stand before the unit number ``cut``: whole blocks first, then units of the block that holds it."""
    start = F.struct(F.lit(0).alias("whole"), cut.cast("long").alias("rest"), F.lit(False).alias("found"))

    def step(state: Column, n: Column) -> Column:
        goes_on = ~state["found"] & (state["rest"] >= n)
        return F.struct(
            F.when(goes_on, state["whole"] + 1).otherwise(state["whole"]).alias("whole"),
            F.when(goes_on, state["rest"] - n).otherwise(state["rest"]).alias("rest"),
            (~goes_on).alias("found"),
        )

    def measure(at: Column) -> Column:
        inside = F.slice(units(F.get(text_blocks, at["whole"]), grammar), F.lit(1), at["rest"].cast("int"))
        joined = lambda parts: F.length(F.array_join(parts, "")).cast("long")
        return joined(F.slice(text_blocks, F.lit(1), at["whole"])) + F.coalesce(joined(inside), F.lit(0).cast("long"))

    return measure(F.aggregate(sizes, start, step))


def transform(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    grammar: str = "code_point",
    plain_percent: int = PLAIN_PERCENT,
    suffix_first_percent: int = SUFFIX_FIRST_PERCENT,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), the number of characters of prefix and middle (null
    where plain), the text and the output.

    Null and empty texts have no units and stay plain and empty, as do whole the texts that hold a mark. Very long texts
    are cut whole, in blocks. A null id draws as the empty text would; repeated rows and equal ids come out alike, one by one;
    other columns are not read; no documents give no rows.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"), 256)
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), digest.alias("digest"), blocks(text, grammar, block).alias("blocks"))
    draw = lambda k: F.conv(F.substring("digest", 8 * k - 7, 8), 16, 10).cast("long")
    rows = rows.withColumn("sizes", F.transform("blocks", lambda b: F.size(units(b, grammar)).cast("long")))
    rows = rows.withColumn("n", F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked = marked | F.contains("text", F.lit(mark))
    plain = (F.length("text") == 0) | marked | (draw(3) % 100 >= 100 - plain_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(draw(4) % 100 < suffix_first_percent, "spm").otherwise("psm"))
    first, second = draw(1) % (F.col("n") + 1), draw(2) % (F.col("n") + 1)
    before = lambda cut: F.when(F.col("form") != "plain", _characters_before(F.col("blocks"), F.col("sizes"), cut, grammar))
    rows = rows.withColumns({"a": before(F.least(first, second)), "b": before(F.greatest(first, second))})
    piece = lambda start, end: F.substring("text", (start + 1).cast("int"), (end - start).cast("int"))
    a, b = F.col("a"), F.col("b")
    prefix, middle, suffix = piece(F.lit(0), a), piece(a, b), piece(b, F.length("text"))
    output = (
        F.when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .when(F.col("form") == "spm", F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
        .otherwise(F.col("text"))
    )
    return rows.select("doc_id", "n", "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"), "text", output.alias("output"))


def restore(output: Column, form: Column) -> Column:
    """The exact text of an output: transformed texts hold no marks, so the three marks of the output are its own."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return (
        F.when(form == "psm", F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2))))
        .when(form == "spm", F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1))))
        .otherwise(output)
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = transform(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    restored = restore(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored).alias("restored_sha256"))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, t, length(t) AS n, ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
f AS (SELECT *, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b FROM h),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM p"""
