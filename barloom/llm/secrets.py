"""Secrets in texts: fixed forms, and long tokens that pass a battery of randomness tests (operator 12). DataFrame functions only.

Fixed forms are assignments to a secret's name, access keys and hexadecimal runs. A further token (20 or more characters of
an encoding's alphabet) is judged in two ways, on its symbols under the smallest alphabet that holds it:

* battery: chi-squared of the symbol counts against uniformity, runs above and below the alphabet's middle, and serial
  correlation of neighbours. The three chances are combined by Fisher's rule; a token that fails is not random.
* structure: the index of coincidence is tested against that of written words (digits, for hexadecimal). A short token can
  hardly be told from words, so it gets a large chance however random it is.

The structure test is one of many, so its false discoveries are controlled over the whole corpus (Benjamini-Hochberg), by
encoding and length band. Every distinct token counts once, copies do not move the levels. Chances are kept in steps of a
tenth of a decade, so the control needs a table of encodings, bands and steps only, whatever the number of tokens.

Texts are read once, for matches and the lengths between them. Places follow from running sums over a document's matches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.llm.common import read, stored

KINDS = ("assign", "access", "hex", "random")
_NAMES = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # a longest run, 20 characters or more
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: (form, alphabet, index of coincidence of structured tokens, sum of cubed shares). The smallest comes first.
ENCODINGS = {
    "hex": ("^([0-9a-f]+|[0-9A-F]+)$", _DIGITS + "abcdef", 0.1, 0.01),
    "base32": ("^[A-Z2-7]+$", _UPPER + "234567", 0.065, 0.0054),
    "base62": ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, 0.065, 0.0054),
    "base64": ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", 0.065, 0.0054),
    "base64url": ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", 0.065, 0.0054),
}
#: Lengths from which a token is in the next band.
BANDS = (28, 40, 64, 128)
_MOST_STEP = 120


def _found(text: Column, pattern: str, values: int = 0) -> Column:
    """Matches in order: (characters since the match before, characters of it, value)."""
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.length(x).cast("long"))
    sizes = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x).cast("long"))
    given = F.regexp_extract_all(text, F.lit(pattern), F.lit(values))
    # one more gap than matches: the last one is left out
    zipped = F.transform(F.arrays_zip(sizes.alias("size"), given.alias("value")), lambda x, i: F.struct(F.get(gaps, i).alias("gap"), x["size"].alias("size"), x["value"].alias("value")))
    return F.when(text.rlike(pattern), zipped)


def matches(docs: DataFrame) -> DataFrame:
    """(key, doc_id, found) of every row of docs (doc_id, text): matches by kind. key: unique per row, stored with it."""
    text = F.coalesce("text", F.lit(""))
    patterns = ((ASSIGN, 2), (ACCESS, 0), (HEX, 0), (TOKEN, 0))
    kinds = [F.struct(F.lit(kind).alias("kind"), _found(F.col("text"), p, v).alias("m")) for kind, (p, v) in zip(KINDS, patterns, strict=True)]
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    return stored(rows.select("key", "doc_id", F.filter(F.array(*kinds), lambda x: x["m"].isNotNull()).alias("found")), "matches")


def spans(found: DataFrame) -> DataFrame:
    """(key, kind, start, end, value) of the matches that hold; end is exclusive, both count code points."""
    rows = found.select("key", F.explode("found").alias("x")).select("key", "x.kind", F.posexplode("x.m").alias("i", "m"))
    end = F.sum(F.col("m.gap") + F.col("m.size")).over(Window.partitionBy("key", "kind").orderBy("i"))  # a document's own matches
    rows = rows.select("key", "kind", (end - F.col("m.size")).alias("start"), end.alias("end"), F.col("m.value").alias("value"))
    return rows.filter((F.col("kind") != "assign") | (F.length("value") >= 6))


def _tail(z: Column) -> Column:
    """Chance that a normal variable exceeds z (a logistic form, right to 0.00014)."""
    z = F.greatest(F.lit(-8.0), F.least(F.lit(8.0), z))
    return 1 / (1 + F.exp(1.5976 * z + 0.070565 * z * z * z))


def judged(tokens: DataFrame) -> DataFrame:
    """(value, encoding, n, random, structured) of tokens: the battery's chance if random, and the chance of so low an index of
    coincidence if written. Tokens of digits only or of no single alphabet are left out."""
    bare = tokens.select("value", F.rtrim(F.col("value"), F.lit("=")).alias("t")).filter("t RLIKE '[A-Za-z]'")
    encoding = F.coalesce(*(F.when(F.col("t").rlike(form), F.lit(name)) for name, (form, *_) in ENCODINGS.items()))

    def of(part: int) -> Column:
        return F.coalesce(*(F.when(F.col("encoding") == name, F.lit(x[part])) for name, x in ENCODINGS.items()))

    rows = bare.withColumn("encoding", encoding).filter("encoding IS NOT NULL")
    rows = rows.withColumns({"t": F.when(F.col("encoding") == "hex", F.lower("t")).otherwise(F.col("t")), "alphabet": of(1), "coincidence": of(2), "cubes": of(3)})
    rows = rows.withColumns({
        "n": F.length("t"), "k": F.length("alphabet"),
        "x": F.transform(F.sequence(F.lit(1), F.length("t")), lambda i: F.call_function("instr", F.col("alphabet"), F.substring("t", i, F.lit(1))) - 1),
        "c": F.transform(F.sequence(F.lit(1), F.length("alphabet")), lambda i: F.length("t") - F.length(F.replace(F.col("t"), F.substring("alphabet", i, F.lit(1)), F.lit("")))),
    })
    zero = F.lit(0).cast("long")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, v: a + v)

    pairs = F.arrays_zip(F.slice("x", F.lit(1), F.col("n") - 1).alias("a"), F.slice("x", F.lit(2), F.col("n") - 1).alias("b"))
    high = lambda v: v * 2 >= F.col("k")
    rows = rows.select(
        "value", "encoding", "n", "k", "coincidence", "cubes", total(F.transform("c", lambda c: c * c)).alias("squares"),
        total(F.transform("c", lambda c, i: c * i)).alias("s1"), total(F.transform("c", lambda c, i: c * i * i)).alias("s2"),
        total(F.transform("c", lambda c, i: F.when(high(i), c).otherwise(0))).alias("n1"),
        total(F.transform(pairs, lambda p: p["a"] * p["b"])).alias("products"),
        total(F.transform(pairs, lambda p: F.when(high(p["a"]) != high(p["b"]), 1).otherwise(0))).alias("changes"),
        (F.element_at("x", 1) + F.element_at("x", -1)).alias("ends"))
    n, k, n1 = F.col("n").cast("double"), F.col("k").cast("double"), F.col("n1").cast("double")
    chi = (k * F.col("squares") / n - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
    expected = 1 + 2 * n1 * (n - n1) / n
    spread = F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(0.01))
    runs = F.abs(F.col("changes") + 1 - expected) / F.sqrt(spread)
    one_side = (n1 == 0) | (n1 == n)
    mean = F.col("s1") / n
    below = F.col("s2") - n * mean * mean
    r = (F.col("products") - mean * (2 * F.col("s1") - F.col("ends")) + (n - 1) * mean * mean) / F.greatest(below, F.lit(0.01))
    serial = F.abs(r + 1 / n) * F.sqrt(n)
    chances = (_tail(chi), F.when(one_side, 0.0).otherwise(2 * _tail(runs)), F.when(below < 0.01, 0.0).otherwise(2 * _tail(serial)))
    product = F.lit(1.0)
    for p in chances:
        product = product * F.greatest(F.lit(1e-12), F.least(F.lit(1.0), p))
    log = F.log("product")
    seen = (F.col("squares") - n) / (n * (n - 1))
    twice = F.col("coincidence") * F.col("coincidence")
    variance = 2 / (n * (n - 1)) * (F.col("coincidence") - twice) + 4 * (n - 2) / (n * (n - 1)) * F.greatest(F.col("cubes") - twice, F.lit(0.0))
    rows = rows.withColumns({"product": product, "structured": _tail((F.col("coincidence") - seen) / F.sqrt(variance))})
    return rows.select("value", "encoding", "n", (F.col("product") * (1 - log + log * log / 2)).alias("random"), "structured")


def random_tokens(tokens: DataFrame, false_share: float = 0.05, least_random: float = 0.001) -> DataFrame:
    """The distinct tokens (value) found random: the battery gives `least_random` or more, and the structure is rejected at the
    level of the token's encoding and length band where false discoveries are at most `false_share`."""
    rows = judged(tokens.select("value").distinct())
    band = sum((F.when(F.col("n") >= b, 1).otherwise(0) for b in BANDS), F.lit(0)).alias("band")
    step = F.least(F.lit(_MOST_STEP), F.floor(-10 * F.log10("structured"))).cast("int").alias("step")
    rows = stored(rows.select("value", "encoding", band, step, (F.col("random") >= least_random).alias("random")), "judged")
    tested = rows.groupBy("encoding", "band", "step").agg(F.count("*").alias("n"))
    level = Window.partitionBy("encoding", "band")
    tested = tested.withColumns({"all": F.sum("n").over(level), "above": F.sum("n").over(level.orderBy(F.desc("step")))})
    held = F.col("all") * F.pow(F.lit(10.0), -F.col("step") / 10) <= false_share * F.col("above")
    levels = tested.filter(held).groupBy("encoding", "band").agg(F.min("step").alias("least"))
    found = rows.join(F.broadcast(levels), ["encoding", "band"])  # a row per encoding and band
    return found.filter("random AND step >= least").select("value")


def secrets(docs: DataFrame, false_share: float = 0.05, least_random: float = 0.001) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of docs (doc_id, text).

    A random token's span counts if it meets no span of a fixed form in its document. Null texts are empty; rows without or
    with the same doc_id are documents of their own; repeated rows count each, a repeated token is tested once. Further
    columns are not read; no rows give no rows.
    """
    found = matches(docs)
    rows = stored(spans(found), "spans")
    base, tokens = rows.filter("kind != 'random'"), rows.filter("kind = 'random'")
    chosen = tokens.join(random_tokens(tokens, false_share, least_random), "value")
    both = base.select("key", "kind", "start", "end").unionByName(chosen.select("key", "kind", "start", "end"))
    rank = sum((F.when(F.col("kind") == kind, i).otherwise(0) for i, kind in enumerate(KINDS)), F.lit(0)).alias("rank")
    listed = both.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", rank, "kind", "end"))).alias("all"))  # a document's own spans
    fixed = F.filter("all", lambda x: x["kind"] != "random")
    apart = F.filter("all", lambda x: (x["kind"] != "random") | ~F.exists(F.col("fixed"), lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))

    def text(values: str) -> Column:
        return F.array_join(F.transform(values, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    listed = listed.withColumn("fixed", fixed).withColumn("all", apart)

    def count(kind: str) -> Column:
        return F.size(F.filter("fixed", lambda x: x["kind"] == kind))

    counts = {f"n_{kind}": count(kind) for kind in KINDS[:3]}
    listed = listed.select("key", *(c.cast("long").alias(name) for name, c in counts.items()), F.sha2(text("fixed"), 256).alias("digest"), text("all").alias("spans"))
    out = found.select("key", "doc_id").join(listed, "key", "left")
    return out.select("doc_id", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in counts),
                      F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"))


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets(read(spark, sf_dir, "documents", "doc_id", "text"))


ORACLE_SQL = r"""
WITH texts AS (SELECT row_number() OVER () AS key, doc_id, coalesce(text, '') AS text FROM documents),
forms(kind, rank, pattern, part) AS (VALUES
  ('assign', 0, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2),
  ('access', 1, 'AKIA[A-Z0-9]{16,}', 0), ('hex', 2, '[0-9a-f]{24,}', 0), ('random', 3, '[A-Za-z0-9+/_-]{20,}={0,2}', 0)),
parts AS (
  SELECT key, 'assign' AS kind, regexp_split_to_array(text, (SELECT pattern FROM forms WHERE rank = 0)) AS gaps,
    regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS whole,
    regexp_extract_all(text, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals FROM texts
  UNION ALL SELECT key, 'access', regexp_split_to_array(text, 'AKIA[A-Z0-9]{16,}'), regexp_extract_all(text, 'AKIA[A-Z0-9]{16,}') AS w, w FROM texts
  UNION ALL SELECT key, 'hex', regexp_split_to_array(text, '[0-9a-f]{24,}'), regexp_extract_all(text, '[0-9a-f]{24,}') AS w, w FROM texts
  UNION ALL SELECT key, 'random', regexp_split_to_array(text, '[A-Za-z0-9+/_-]{20,}={0,2}'), regexp_extract_all(text, '[A-Za-z0-9+/_-]{20,}={0,2}') AS w, w FROM texts),
listed AS (SELECT key, kind, unnest(range(1, len(whole) + 1)) AS i, gaps, whole, vals FROM parts WHERE len(whole) > 0),
placed AS (
  SELECT key, kind, vals[i] AS value, length(whole[i]) AS size,
    CAST(sum(length(gaps[i]) + length(whole[i])) OVER (PARTITION BY key, kind ORDER BY i) AS BIGINT) AS stop FROM listed),
spans AS (SELECT key, kind, stop - size AS start, stop, value FROM placed WHERE kind != 'assign' OR length(value) >= 6),
bare AS (SELECT value, rtrim(value, '=') AS t FROM (SELECT DISTINCT value FROM spans WHERE kind = 'random') WHERE regexp_matches(rtrim(value, '='), '[A-Za-z]')),
coded AS (
  SELECT value, t, CASE WHEN regexp_full_match(t, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(t, '[A-Z2-7]+') THEN 'base32'
    WHEN regexp_full_match(t, '[A-Za-z0-9]+') THEN 'base62' WHEN regexp_full_match(t, '[A-Za-z0-9+/]+') THEN 'base64'
    WHEN regexp_full_match(t, '[A-Za-z0-9_-]+') THEN 'base64url' END AS encoding FROM bare),
alphabets(encoding, alphabet, coincidence, cubes) AS (VALUES
  ('hex', '0123456789abcdef', CAST(0.1 AS DOUBLE), CAST(0.01 AS DOUBLE)), ('base32', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 0.065, 0.0054),
  ('base62', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789', 0.065, 0.0054),
  ('base64', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/', 0.065, 0.0054),
  ('base64url', 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_', 0.065, 0.0054)),
symbols AS (
  SELECT value, encoding, coincidence, cubes, length(alphabet) AS k, length(t) AS n,
    list_transform(range(1, length(t) + 1), lambda i: instr(alphabet, (CASE WHEN encoding = 'hex' THEN lower(t) ELSE t END)[i]) - 1) AS x
  FROM coded JOIN alphabets USING (encoding)),
sums AS (
  SELECT value, encoding, coincidence, cubes, CAST(k AS DOUBLE) AS k, CAST(n AS DOUBLE) AS n,
    list_sum(list_transform(range(0, k), lambda j: len(list_filter(x, lambda v: v = j)) ** 2)) AS squares,
    CAST(list_sum(x) AS DOUBLE) AS s1, CAST(list_sum(list_transform(x, lambda v: v * v)) AS DOUBLE) AS s2,
    CAST(len(list_filter(x, lambda v: 2 * v >= k)) AS DOUBLE) AS n1,
    CAST(list_sum(list_transform(range(1, n), lambda i: x[i] * x[i + 1])) AS DOUBLE) AS products,
    CAST(list_sum(list_transform(range(1, n), lambda i: CASE WHEN (2 * x[i] >= k) != (2 * x[i + 1] >= k) THEN 1 ELSE 0 END)) AS DOUBLE) AS changes,
    CAST(x[1] + x[n] AS DOUBLE) AS ends FROM symbols),
tests AS (
  SELECT value, encoding, n, n1, s2 - n * (s1 / n) * (s1 / n) AS below,
    (k * squares / n - n - (k - 1)) / sqrt(2 * (k - 1) * (1 - 1 / n)) AS z1,
    abs(changes + 1 - (1 + 2 * n1 * (n - n1) / n)) / sqrt(greatest(((1 + 2 * n1 * (n - n1) / n) - 1) * ((1 + 2 * n1 * (n - n1) / n) - 2) / (n - 1), CAST(0.01 AS DOUBLE))) AS z2,
    abs((products - (s1 / n) * (2 * s1 - ends) + (n - 1) * (s1 / n) * (s1 / n)) / greatest(s2 - n * (s1 / n) * (s1 / n), CAST(0.01 AS DOUBLE)) + 1 / n) * sqrt(n) AS z3,
    (coincidence - (squares - n) / (n * (n - 1))) / sqrt(2 / (n * (n - 1)) * (coincidence - coincidence * coincidence)
      + 4 * (n - 2) / (n * (n - 1)) * greatest(cubes - coincidence * coincidence, CAST(0 AS DOUBLE))) AS z4 FROM sums),
tails AS (
  SELECT value, encoding, n, n1, below,
    list_transform([z1, z2, z3, z4], lambda z: 1 / (1 + exp(CAST(1.5976 AS DOUBLE) * greatest(-8, least(8, z)) + CAST(0.070565 AS DOUBLE) * greatest(-8, least(8, z)) ** 3))) AS q FROM tests),
chances AS (
  SELECT value, encoding, n, q[4] AS structured,
    list_product(list_transform([q[1], CASE WHEN n1 = 0 OR n1 = n THEN 0 ELSE 2 * q[2] END, CASE WHEN below < 0.01 THEN 0 ELSE 2 * q[3] END],
      lambda p: greatest(CAST(1e-12 AS DOUBLE), least(1, p)))) AS p FROM tails),
steps AS (
  SELECT value, encoding, CASE WHEN n >= 128 THEN 4 WHEN n >= 64 THEN 3 WHEN n >= 40 THEN 2 WHEN n >= 28 THEN 1 ELSE 0 END AS band,
    CAST(least(120, floor(-10 * log10(structured))) AS INT) AS step, p * (1 - ln(p) + ln(p) * ln(p) / 2) >= 0.001 AS random FROM chances),
tested AS (SELECT encoding, band, step, count(*) AS n FROM steps GROUP BY ALL),
above AS (SELECT encoding, band, step, sum(n) OVER (PARTITION BY encoding, band) AS total, sum(n) OVER (PARTITION BY encoding, band ORDER BY step DESC) AS high FROM tested),
levels AS (SELECT encoding, band, min(step) AS least FROM above WHERE total * pow(CAST(10 AS DOUBLE), CAST(-step AS DOUBLE) / 10) <= 0.05 * high GROUP BY ALL),
chosen AS (SELECT value FROM steps JOIN levels USING (encoding, band) WHERE random AND step >= least),
fixed AS (SELECT key, kind, start, stop FROM spans WHERE kind != 'random'),
added AS (
  SELECT DISTINCT key, kind, start, stop FROM spans WHERE kind = 'random' AND value IN (SELECT value FROM chosen)
    AND NOT EXISTS (SELECT 1 FROM fixed f WHERE f.key = spans.key AND f.start < spans.stop AND spans.start < f.stop)),
strings AS (SELECT key, rank, kind, start, kind || ':' || start || ':' || stop AS s FROM (SELECT * FROM fixed UNION ALL SELECT * FROM added) JOIN forms USING (kind)),
listed_all AS (
  SELECT key, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(s, ',' ORDER BY start, rank) FILTER (rank < 3) AS base, string_agg(s, ',' ORDER BY start, rank) AS spans FROM strings GROUP BY key)
SELECT doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN listed_all USING (key)
"""
