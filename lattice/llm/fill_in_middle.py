"""Fill-in-the-middle examples by escaped marker injection.

A text's units are runs of the letters A-Z and a-z, and every other character by itself. A delimiter that texts may hold too is
escaped there, ``regexp_replace`` then writes one after each unit, so that counting delimiters counts units, and ``substring_index``
cuts the text at any of them from either end. Without delimiters and escapes the parts are the text's own again. All of it is
DataFrame functions: a row is made from its own columns alone, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Ends a unit. In texts it becomes ESCAPE and 1, ESCAPE itself becomes ESCAPE and 0.
DELIMITER, ESCAPE = "\x01", "\x02"
UNIT = r"[A-Za-z]+|\x02[01]|[^A-Za-z]"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
SEED = "1"
_OWN = ("n", "form", "prefix", "middle", "suffix", "output")


def injected(text: Column) -> Column:
    """``text`` with its delimiters escaped and a delimiter after each unit."""
    return F.regexp_replace(F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "0")), F.lit(DELIMITER), F.lit(ESCAPE + "1")), UNIT, "$0" + DELIMITER)


def plain_text(part: Column) -> Column:
    """What ``injected`` was made from; a part of it, too."""
    return F.replace(F.replace(F.replace(part, F.lit(DELIMITER), F.lit("")), F.lit(ESCAPE + "1"), F.lit(DELIMITER)), F.lit(ESCAPE + "0"), F.lit(ESCAPE))


def part(marked: str, first: str, last: str, n: str) -> Column:
    """Units first+1 to last of the column ``marked``, which has n units."""
    head = F.expr(f"CASE WHEN `{last}` >= `{n}` THEN `{marked}` ELSE concat(substring_index(`{marked}`, '{DELIMITER}', `{last}`), '{DELIMITER}') END")
    return plain_text(F.when(F.col(first) >= F.col(last), "").otherwise(F.call_function("substring_index", head, F.lit(DELIMITER), -(F.col(last) - F.col(first) + 1))))


def draws(id_: Column, seed: str = SEED) -> list[Column]:
    """Four numbers below 2^32 from an id; a null id counts as no characters."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), seed: str = SEED, plain_percent: int = PLAIN_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """One row for each row: the id and ``keep`` as they are, n (units of the text), form (plain, psm or spm), prefix, middle and suffix
    (null if plain) and output. ``keep`` may not name one of these.

    A null text is empty; an empty text and one that holds a marker stay plain, as do plain_percent of the others; of those that are
    left spm_percent go suffix first. The two cuts fall after any unit with equal chances, and may be equal: parts may be empty. All is drawn from
    seed and id, so repeated ids and repeated rows are cut by the same draws, and any order of rows gives the same. Other columns are ignored,
    an empty table gives no rows.
    """
    if set(keep) & set(_OWN):
        raise ValueError("keep names a column of the result")
    kept = list(dict.fromkeys([id_col, *keep]))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(*[F.col(c) for c in kept], text.alias("__text"), *[h.alias(f"__h{i}") for i, h in enumerate(draws(F.col(id_col), seed))])
    rows = rows.withColumn("__marked", injected(F.col("__text")))
    rows = rows.withColumn("n", (F.length("__marked") - F.length(F.replace(F.col("__marked"), F.lit(DELIMITER), F.lit("")))).cast("long"))
    x, y = (F.pmod(F.col(f"__h{i}"), F.col("n") + 1) for i in (0, 1))
    plain = (F.col("n") == 0) | (F.col("__h2") % 100 >= 100 - plain_percent)
    for marker in (PREFIX, SUFFIX, MIDDLE):
        plain = plain | F.contains("__text", F.lit(marker))
    form = F.when(plain, "plain").when(F.col("__h3") % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.withColumns({"form": form, "__0": F.lit(0), "__a": F.least(x, y).cast("int"), "__b": F.greatest(x, y).cast("int"), "__n": F.col("n").cast("int")})
    cut_up = F.col("form") != "plain"
    rows = rows.withColumns({name: F.when(cut_up, part("__marked", lo, hi, "__n")) for name, lo, hi in (("prefix", "__0", "__a"), ("middle", "__a", "__b"), ("suffix", "__b", "__n"))})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("__text"))
    return rows.select(*kept, "n", "form", "prefix", "middle", "suffix", output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that ``output`` of this ``form`` was made from."""
    parts = F.split(output, "<[PSM]>")
    at = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id",
        "n",
        "form",
        F.length("prefix").cast("long").alias("prefix_chars"),
        F.length("middle").cast("long").alias("middle_chars"),
        digest(F.col("output")).alias("output_sha256"),
        digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


SQL = """
WITH units AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h,
    regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents
), drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS y,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM units
), parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(x, y)], '') AS p, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS m,
    array_to_string(u[greatest(x, y) + 1:], '') AS s FROM drawn
)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""
