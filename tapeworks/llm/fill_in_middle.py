r"""Fill-in-the-middle by relations: units as rows, running sums of their lengths, cuts joined by unit ordinal.

1. A text is cut into units, `[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+`, left to right. Four numbers drawn from
   SHA-256 of the seed and doc_id give the form (plain, psm or spm) and the two cuts, as counts of units. The texts that are to
   be cut are written once, with a number for each row.
2. These texts become a row for each unit (`posexplode` of the matches) with its length in code points; a window
   over each text's units runs the lengths up.
3. The cut requests, two ordinals for each text, are joined with the units by row and unit ordinal; a request for a cut before the
   first unit meets none and stands at 0. Offsets are put together for each text, and the text is cut there by `substr`.

Texts are dealt out by row number, units and requests alike, so no join after that shuffles; units and whole texts come from one
shuffle. Only texts that are cut are written, shuffled and exploded. Every step is a DataFrame expression; a text's units are rows of one task, which can spill.

A null text counts as empty. Empty texts, and texts that hold a marker, stay plain. A null doc_id is drawn for as if it were
the empty text. Equal rows give equal results, each row its own; an empty table gives an empty table; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from tapeworks.llm.common import table, written

#: Units, and markers of what follows: prefix, suffix, middle.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, CUT_PERCENT, SPM_PERCENT = "42", 50, 80


def draws(seed: str = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of a document."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(h, 1 + 8 * k, 8), 16, 10).cast("long") for k in range(4)]


def units(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(UNIT), F.lit(0))


def planned(docs: DataFrame, seed: str = SEED, cut: int = CUT_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """row, doc_id, text, n (units), form, a, b (units before the first and the second cut)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    h1, h2, h3, h4 = draws(seed)
    marked = F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when((text == "") | marked | (h3 % 100 >= cut), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    d = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"), F.size(units(text)).cast("long").alias("n"), form.alias("form"), h1.alias("h1"), h2.alias("h2"))
    cuts = [F.col(h) % (F.col("n") + 1) for h in ("h1", "h2")]
    return d.select("row", "doc_id", "text", "n", "form", F.least(*cuts).alias("a"), F.greatest(*cuts).alias("b"))


def offsets(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """row, prefix_chars, cut_chars (code points before the first and the second cut) of planned texts, null for none."""
    matches = dealt.select("row", F.posexplode(units(F.col("text"))).alias("ordinal", "unit"))
    upto = Window.partitionBy("row").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, 0)
    ends = matches.select("row", "ordinal", F.length("unit").alias("chars")).select("row", F.col("ordinal").cast("long").alias("ordinal"), F.sum("chars").over(upto).alias("end"))
    requests = texts.select(F.col("row").alias("of"), (F.col("a") - 1).alias("first"), (F.col("b") - 1).alias("second")).repartition("of")
    asked = (F.col("row") == F.col("of")) & F.array_contains(F.array("first", "second"), F.col("ordinal"))  # by row alone, units would be shuffled again otherwise
    at = [F.max(F.when(F.col("ordinal") == F.col(c), F.col("end"))).alias(k) for c, k in (("first", "prefix_chars"), ("second", "cut_chars"))]
    return ends.join(requests, asked).groupBy("row").agg(*at)


def fill_in_middle(docs: DataFrame, seed: str = SEED, cut: int = CUT_PERCENT, spm: int = SPM_PERCENT) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars (null if plain) and the output text of each row of docs (doc_id, text)."""
    plan = planned(docs, seed, cut, spm)
    none = F.lit(None).cast("long")
    plain = plan.where("form = 'plain'").select("doc_id", "n", "form", none.alias("prefix_chars"), none.alias("middle_chars"), F.col("text").alias("output"))
    texts = written(plan.where("form <> 'plain'"))
    dealt = texts.select("row", "text").repartition("row")  # units and whole texts read the same shuffle
    info = texts.select("row", "doc_id", "n", "form").repartition("row")
    whole = dealt.join(info, "row").join(offsets(dealt, texts), "row", "left").na.fill(0, ["prefix_chars", "cut_chars"])
    p, c, t = F.col("prefix_chars").cast("int"), F.col("cut_chars").cast("int"), F.col("text")
    prefix, middle, suffix = F.substr(t, F.lit(1), p), F.substr(t, p + 1, c - p), F.substr(t, c + 1, F.length(t) - c)
    psm = F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle)
    made = F.when(F.col("form") == "psm", psm).otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    done = whole.select("doc_id", "n", "form", "prefix_chars", (F.col("cut_chars") - F.col("prefix_chars")).alias("middle_chars"), made.alias("output"))
    return plain.unionByName(done)


def restored(output: Column, form: Column) -> Column:
    """The text from which an output was made: cut at its markers, which no such text holds."""

    def between(first: str, second: str) -> Column:
        return F.substring_index(F.substring_index(output, first, -1), second, 1)

    psm = F.concat(between(PREFIX, SUFFIX), F.substring_index(output, MIDDLE, -1), between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), F.substring_index(output, MIDDLE, -1), between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
         sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
drawn AS (SELECT *, CAST(len(u) AS BIGINT) AS n, [CAST('0x' || substr(h, 1 + 8 * k, 8) AS BIGINT) FOR k IN range(4)] AS r FROM d),
cut AS (
  SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain' WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn),
parts AS (SELECT doc_id, t, n, form, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM parts"""
