r"""Secret scans: fixed patterns plus a randomness test battery, in DataFrame functions.

Fixed patterns give the base spans. The battery looks at every token of 20 or more
characters of ``[A-Za-z0-9+/_-]`` with the ``=`` that pad it (an inner ``=`` parts a name
from its value) that no base span overlaps, and infers its encoding from the characters it
uses. Two questions are asked of it.

Is it uniform over its alphabet? A chi-squared test of uniformity, a runs test about the
middle of the alphabet and a test of serial correlation between neighbours, combined by
Simes' rule; a token that fails is no secret.

Could it be ordinary text or an identifier? Under that null its letters repeat as those of
the corpus do (the same chi-squared sum, against the corpus's letter frequencies), letters
and digits come in runs (a runs test), and consonants do not cluster (a test of
neighbours). Only tokens that reject this null are reported, by Benjamini-Hochberg within
strata of encoding and length: short tokens have less power, so they need more evidence.

Positions come from splitting a text by the pattern: the lengths of the pieces and of the
matches, added up, are code-point offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelf.llm.common import Workspace

#: The patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = (
    "(?i:password|passwd|secret|token|api_?key)"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{12,}"  # equals AKIA[A-Z0-9]+ kept from 16 characters on: a run is taken whole
HEX = "[0-9a-f]{32,}+"  # equals [0-9a-f]+ kept from 32 characters on, for the same reason
KINDS = ("assign", "access", "hex", "random")

#: A run of 20 with all its ``=`` ahead, then a piece of it; pieces below ``LEAST`` are left out.
TOKEN = "(?=[A-Za-z0-9+/_=-]{20})[A-Za-z0-9+/_-]++(?:=++(?![A-Za-z0-9+/_-]))?"
LEAST = 20
#: Level of the uniformity tests: the share of truly random tokens that they lose.
LEVEL = 0.001
#: False discovery rate of the reported tokens within each stratum.
FDR = 0.05
#: Steps of p values are tenths of a decimal digit, up to twenty digits.
P_STEP, P_DIGITS = 10, 20
#: Ordinary tokens: the most often that of two neighbours one is a letter and one a digit,
#: that two letters are both consonants, and that two letters differ in case; and the most
#: that the tests of these correlate.
ALTERNATION, CLUSTERS, CASES, CORRELATION = 0.10, 0.40, 0.30, 0.1
#: Lengths at which strata begin.
LENGTHS = (20, 28, 40, 64)
_ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "BASE36": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "base40": "0123456789abcdefghijklmnopqrstuvwxyz+/-_",
    "BASE40": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_",
    "base62": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz",
    "base64": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/",
    "base64url": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz-_",
    "base66": "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_",
}
#: Alphabets that hold signs; with the others, signs only part a token's groups.
_SIGNED = ("base40", "BASE40", "base64", "base64url", "base66")


def spans_of(text: Column, pattern: str, kind: str, group: int = 0, least: int = 0) -> Column:
    """Array of ``(start, kind, end, value)`` of all matches, in order; the value is a group."""
    full = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = full if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.split(text, pattern, -1)
    rank = F.lit(KINDS.index(kind))
    empty = F.array().cast("array<struct<start:int,rank:int,end:int,value:string>>")
    found = F.zip_with(full, value, lambda m, v: F.struct(m.alias("m"), v.alias("v")))
    found = F.zip_with(found, F.slice(pieces, F.lit(1), F.size(full)), lambda f, p: F.struct(f["m"].alias("m"), f["v"].alias("v"), F.length(p).alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["m"])
        span = F.struct(start.alias("start"), rank.alias("rank"), end.alias("end"), x["v"].alias("value"))
        grown = F.when(F.length(x["v"]) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
        return F.struct(end.alias("at"), grown.alias("out"))

    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    summed = F.aggregate(found, start, step, lambda acc: acc["out"])
    return F.when(F.size(full) > 0, summed).otherwise(empty)


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal (Abramowitz and Stegun 26.2.17, error below 1e-7)."""
    x = F.abs(z)
    t = 1.0 / (1.0 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = poly * F.exp(-x * x / 2) / 2.5066282746310002
    return F.when(z >= 0, tail).otherwise(1.0 - tail)


def encoding_of(value: Column) -> Column:
    """Smallest alphabet that a token fits, by name; null where none is inferred.

    Letters alone are taken for a word and digits alone for a number: neither is tested.
    Every other token has an alphabet. Signs belong to base64 and base64url; elsewhere they
    are left out of the test (as in ``sk-...`` and UUIDs) if at least ``LEAST`` characters
    remain, and otherwise the alphabet takes them in.
    """
    body = F.regexp_replace(value, "=+$", "")
    core = F.regexp_replace(body, "[+/_-]", "")
    mixed = body.rlike("[0-9]") & body.rlike("[A-Za-z]")
    lower, upper = body.rlike("[a-z]"), body.rlike("[A-Z]")
    both = mixed & lower & upper
    whole = mixed & ((F.length(core) == F.length(body)) | (F.length(core) >= LEAST))
    return (
        F.when(both & body.rlike("^[0-9A-Za-z]+$"), "base62")
        .when(both & body.rlike("^[0-9A-Za-z+/]+$"), "base64")
        .when(both & body.rlike("^[0-9A-Za-z_-]+$"), "base64url")
        .when(whole & core.rlike("^[0-9a-f]+$"), "hex")
        .when(whole & core.rlike("^[0-9A-F]+$"), "HEX")
        .when(whole & core.rlike("^[A-Z2-7]+$"), "base32")
        .when(whole & ~upper, "base36")
        .when(whole & ~lower, "BASE36")
        .when(whole, "base62")
        .when(mixed & ~upper, "base40")
        .when(mixed & ~lower, "BASE40")
        .when(mixed, "base66")
    )


def tested_part(value: Column, encoding: Column) -> Column:
    """A token without its padding and, unless its alphabet holds them, without signs."""
    return F.when(encoding.isin(*_SIGNED), F.regexp_replace(value, "=+$", "")).otherwise(F.regexp_replace(value, "[+/_=-]", ""))


def battery(tokens: DataFrame) -> DataFrame:
    """Append ``p`` to tokens ``(value, encoding)``: how well the hypothesis stands that a
    token is uniform over its alphabet.

    Steps are columns of their own, so each is computed once for a token.
    """
    alphabet = F.coalesce(*[F.when(F.col("encoding") == k, F.lit(v)) for k, v in _ALPHABETS.items()])
    codes = F.transform(F.split("_body", ""), lambda c: F.position(c, F.col("_alphabet")) - 1)
    t = tokens.withColumn("_alphabet", alphabet).withColumn("_body", tested_part(F.col("value"), F.col("encoding")))
    t = t.withColumn("_codes", codes).withColumn("_n", F.size("_codes").cast("double")).withColumn("_k", F.length("_alphabet").cast("double"))

    total = lambda array: F.aggregate(array, F.lit(0.0), lambda s, x: s + x)
    pairs = lambda c: (F.slice(c, F.lit(2), F.size(c) - 1), F.slice(c, F.lit(1), F.size(c) - 1))

    def count(acc: Column, x: Column) -> Column:
        """Sum of squared symbol counts: in sorted codes, each run adds its length squared."""
        run = F.when(x == acc["last"], acc["run"] + 1.0).otherwise(F.lit(1.0))
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + 2.0 * run - 1.0).alias("sum"))

    zero = F.struct(F.lit(-1).alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    t = t.withColumn("_squares", F.aggregate(F.array_sort("_codes"), zero, count, lambda acc: acc["sum"]))
    chi, free = F.col("_k") * F.col("_squares") / F.col("_n") - F.col("_n"), F.col("_k") - 1.0
    wilson = (F.pow(F.greatest(chi, F.lit(1e-9)) / free, 1.0 / 3.0) - (1.0 - 2.0 / (9.0 * free))) / F.sqrt(2.0 / (9.0 * free))
    t = t.withColumn("_z_chi", wilson)

    t = t.withColumn("_high", F.transform("_codes", lambda c: (c * 2 >= F.col("_k")).cast("double"))).withColumn("_ones", total(F.col("_high")))
    t = t.withColumn("_changes", total(F.zip_with(*pairs(F.col("_high")), lambda a, b: F.abs(a - b))))
    zeros = F.col("_n") - F.col("_ones")
    t = t.withColumn("_mean", 2.0 * F.col("_ones") * zeros / F.col("_n") + 1.0)
    spread = F.sqrt(F.greatest((F.col("_mean") - 1.0) * (F.col("_mean") - 2.0) / (F.col("_n") - 1.0), F.lit(1e-9)))
    t = t.withColumn("_z_runs", F.when((F.col("_ones") > 0) & (zeros > 0), F.abs((F.col("_changes") + 1.0 - F.col("_mean")) / spread)))

    t = t.withColumn("_middle", total(F.transform("_codes", lambda c: c.cast("double"))) / F.col("_n"))
    t = t.withColumn("_off", F.transform("_codes", lambda c: c - F.col("_middle")))
    t = t.withColumn("_joint", total(F.zip_with(*pairs(F.col("_off")), lambda a, b: a * b))).withColumn("_whole", total(F.transform("_off", lambda x: x * x)))
    t = t.withColumn("_z_serial", F.when(F.col("_whole") > 0, F.abs((F.col("_joint") / F.col("_whole") + 1.0 / F.col("_n")) * F.sqrt("_n"))))

    two_sided = lambda z: F.coalesce(2.0 * normal_tail(F.col(z)), F.lit(0.0))
    t = t.withColumn("_ranked", F.array_sort(F.array(normal_tail(F.col("_z_chi")), two_sided("_z_runs"), two_sided("_z_serial"))))
    simes = F.least(F.lit(1.0), 3.0 * F.col("_ranked")[0], 1.5 * F.col("_ranked")[1], F.col("_ranked")[2])
    return t.withColumn("p", simes).select(*tokens.columns, "_body", "p")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_counts(text: Column) -> Column:
    """How often each small letter occurs in a text."""
    return F.array(*[F.length(text) - F.length(F.replace(text, F.lit(c), F.lit(""))) for c in _LOWER])


def letter_moments(counts: list[int], among: str) -> tuple[float, float]:
    """Sums of squares and cubes of the shares that letters have of those in ``among``."""
    held = [n for c, n in zip(_LOWER, counts, strict=True) if c in among]
    total = sum(held)
    shares = [n / total if total else 1 / len(held) for n in held]
    return sum(x**2 for x in shares), sum(x**3 for x in shares)


def ordinary(tokens: DataFrame, counts: list[int]) -> DataFrame:
    """Append ``q`` to tokens ``(encoding, _body)``: how well the hypothesis stands that a
    token is ordinary, from one-sided z scores added up; that of case counts in tokens of both cases."""
    hexed = F.col("encoding").isin("hex", "HEX")
    of = {name: letter_moments(counts, among) for name, among in (("hex", "abcdef"), ("any", _LOWER))}
    two, three = (F.when(hexed, F.lit(of["hex"][k])).otherwise(F.lit(of["any"][k])) for k in (0, 1))
    plain = F.translate("_body", "+/_-" + _UPPER, "\0\0\0\0" + _LOWER)
    t = tokens.withColumn("_plain", F.regexp_replace(plain, "[^0-9a-z]", ""))
    t = t.withColumn("_letters", F.array_sort(F.split(F.regexp_replace("_plain", "[0-9]", ""), ""))).withColumn("_m", F.size("_letters").cast("double"))

    def count(acc: Column, x: Column) -> Column:
        run = F.when(x == acc["last"], acc["run"] + 1.0).otherwise(F.lit(0.0))
        return F.struct(x.alias("last"), run.alias("run"), (acc["sum"] + 2.0 * run).alias("sum"))

    zero = F.struct(F.lit("").alias("last"), F.lit(0.0).alias("run"), F.lit(0.0).alias("sum"))
    t = t.withColumn("_pairs", F.aggregate("_letters", zero, count, lambda acc: acc["sum"]))
    m = F.col("_m")
    spread = 2.0 * m * (m - 1.0) * (two + 2.0 * (m - 2.0) * three - (2.0 * m - 3.0) * two * two)
    t = t.withColumn("_z_letters", F.when((m > 2) & (spread > 0), (m * (m - 1.0) * two - F.col("_pairs")) / F.sqrt(F.greatest(spread, F.lit(1e-9)))).otherwise(0.0))

    def excess(seen: Column, of: Column, rate: float) -> Column:
        """z score of a count above a binomial of the given rate, with continuity correction."""
        return F.when(of > 0, (seen - 0.5 - of * rate) / F.sqrt(F.greatest(of, F.lit(1.0)) * (rate * (1 - rate)))).otherwise(0.0)

    kinds = F.translate("_plain", "0123456789" + _LOWER, "0" * 10 + "".join("a" if c in "aeiouy" else "b" for c in _LOWER))
    t = t.withColumn("_kinds", kinds).withColumn("_n", F.length("_plain"))
    at = lambda pattern: F.regexp_count("_kinds", F.lit(pattern))
    t = t.withColumn("_turns", at("0(?=[ab])|[ab](?=0)")).withColumn("_clusters", at("b(?=b)")).withColumn("_next", at("[ab](?=[ab])"))
    t = t.withColumn("_z_turns", excess(F.col("_turns"), F.col("_n") - 1, ALTERNATION)).withColumn("_z_clusters", excess(F.col("_clusters"), F.col("_next"), CLUSTERS))
    cases = lambda pattern: F.regexp_count("_body", F.lit(pattern))
    t = t.withColumn("_shifts", cases("[a-z](?=[+/_-]?[A-Z])|[A-Z](?=[+/_-]?[a-z])"))
    t = t.withColumn("_z_cases", F.when(F.rlike("_body", F.lit("[a-z]")) & F.rlike("_body", F.lit("[A-Z]")), excess(F.col("_shifts"), F.col("_next"), CASES)))
    added = F.col("_z_letters") + F.col("_z_turns") + F.col("_z_clusters")
    width = lambda k: (k + k * (k - 1) * CORRELATION) ** 0.5
    z = F.when(F.col("_z_cases").isNull(), added / width(3)).otherwise((added + F.col("_z_cases")) / width(4))
    return t.select(*[c for c in tokens.columns if c != "_body"], normal_tail(z).alias("q"))


def stratum(encoding: Column, length: Column) -> Column:
    band = sum(((length >= at).cast("int") for at in LENGTHS[1:]), F.lit(0))
    return F.concat_ws(":", encoding, band.cast("string"))


def step_of(p: Column) -> Column:
    """Step of a p value, the higher the smaller it is; a step stands for its largest value."""
    return F.floor(F.least(F.lit(float(P_DIGITS)), -F.log10(F.greatest(p, F.lit(1e-300)))) * P_STEP).cast("int")


def discoveries(tokens: DataFrame, rate: float) -> DataFrame:
    """``stratum, cut``: tokens of a stratum from step ``cut`` on reject the ordinary null.

    Benjamini-Hochberg within each stratum, from counts of p values in steps, so the ranking
    is over at most ``P_STEP * P_DIGITS + 1`` rows a stratum, however many tokens there are.
    """
    steps = tokens.groupBy("stratum", "step").agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("stratum").orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = steps.withColumn("rank", F.sum("n").over(order)).withColumn("m", F.sum("n").over(Window.partitionBy("stratum")))
    passed = F.pow(F.lit(10.0), -F.col("step") / P_STEP) <= rate * F.col("rank") / F.col("m")
    return ranked.groupBy("stratum").agg(F.min(F.when(passed, F.col("step"))).alias("cut")).where("cut is not null")


def scan(docs: DataFrame, level: float = LEVEL, rate: float = FDR) -> DataFrame:
    """Spans of secrets in every whole text: ``doc_id, base, added``, arrays of
    ``(start, rank, end)`` ordered by start, then by place in ``KINDS``.

    Added spans overlap no base span. Null and empty texts have no spans; texts are read
    whole, however long. Repeated rows have equal spans, and each counts in the control of
    false discoveries. Columns besides ``doc_id, text`` are not read. An empty table gives
    an empty result.
    """
    ws = Workspace(docs.sparkSession, "secrets")
    text = F.coalesce(F.col("text"), F.lit(""))
    base = F.array_sort(
        F.concat(spans_of(text, ASSIGN, "assign", group=1, least=8), spans_of(text, ACCESS, "access"), spans_of(text, HEX, "hex"))
    )
    tokens = F.filter(
        F.transform(spans_of(text, TOKEN, "random", least=LEAST), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), encoding_of(s["value"]).alias("encoding"))),
        lambda s: s["encoding"].isNotNull(),
    )
    bare = F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", bare.alias("base"), tokens.alias("tokens"), letter_counts(text).alias("letters"))
    rows = ws.save(rows, "rows")
    sums = rows.agg(*[F.coalesce(F.sum(F.col("letters")[k]), F.lit(0)).alias(c) for k, c in enumerate(_LOWER)]).first()
    each = rows.select("uid", "base", F.explode("tokens").alias("t"))
    each = each.where(~F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))).select("uid", "t.*")
    tested = ordinary(battery(each), list(sums)).select("uid", "start", "end", "encoding", "p", "q")
    # a table of its own, so that no filter is pushed below the tests and repeats them
    tested = ws.save(tested, "tested").where(F.col("p") > level)
    tested = tested.select("uid", "start", "end", stratum(F.col("encoding"), F.col("end") - F.col("start")).alias("stratum"), step_of(F.col("q")).alias("step"))
    # at most one row for each encoding and length band
    cuts = F.broadcast(discoveries(tested, rate))
    random = tested.join(cuts, "stratum").where(F.col("step") >= F.col("cut"))
    span = F.struct("start", F.lit(KINDS.index("random")).alias("rank"), "end")
    added = random.groupBy("uid").agg(F.array_sort(F.collect_list(span)).alias("added"))
    none = F.array().cast("array<struct<start:int,rank:int,end:int>>")
    return rows.join(added, "uid", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of ordered spans, comma-joined."""
    kind = lambda s: F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["rank"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda kind: F.size(F.filter("base", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return scan(docs).select(
        "doc_id",
        *[count(k) for k in KINDS[:3]],
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
