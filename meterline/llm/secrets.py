"""Secret scan: fixed patterns, and a randomness test battery over other long tokens.

Columns and SQL functions only. Fixed patterns give the base spans. Every other run of
20 or more characters of `[A-Za-z0-9+/_=-]` that mixes letters and digits is a candidate.
Its encoding is inferred (hex, base32, alphanumeric, base64), and three tests ask whether
it looks like independent uniform draws from that alphabet: chi-squared of the character
counts, runs above and below the middle of the alphabet, and lag-one serial correlation.
Their p-values are joined by Bonferroni. A Benjamini-Hochberg step inside each pair of
encoding and length class decides which candidates are *not* random (short tokens have
weak tests and get their own level); what is left is reported as a secret.

Defined cases: null or empty text has no spans; a null id is carried; repeated rows give
repeated results; other columns of the input are dropped by `scan_secrets` and kept by
`redact_secrets`.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from meterline.llm.common import once, written

# The base patterns in the order in which kinds are listed.
KINDS = ("assign", "access", "hex")
ASSIGN = (
    "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS = "AKIA[A-Z0-9]{14,}"  # greedy runs: the same as AKIA[A-Z0-9]+ of 18 or more
HEX = "[0-9a-f]{16,}"
ASSIGN_LEAST = 12

CANDIDATE = "[A-Za-z0-9+/_=-]{20,}"
DISCOVERY_RATE = 0.05
P_BINS = 60  # of -log2 p, for the step-up procedure
MASK = "[secret]"

ALPHABETS = {
    "hex": "0123456789abcdef",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "alnum": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
}

SPAN = "array<struct<start:bigint,rank:int,stop:bigint,kind:string,value:string>>"


def found(text: Column, pattern: str, kind: str, rank: int, least: int | None = None) -> Column:
    """Spans of all leftmost non-overlapping matches, in code points.

    The pieces between matches and the matches themselves alternate, so that running
    lengths give the positions.
    """
    between = F.split(text, F.lit(pattern), -1)
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = {"between": between, "values": values}
    if least is not None:
        parts["size"] = F.transform(
            F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda x: F.length(x)
        )
    step = F.expr(
        "struct(cast(0 as bigint) as pos, cast(array() as " + SPAN + ") as spans)"
    )

    def walk(p: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(F.get(p["between"], i))
            stop = start + F.length(F.get(p["values"], i))
            span = F.struct(
                start.cast("bigint").alias("start"),
                F.lit(rank).alias("rank"),
                stop.cast("bigint").alias("stop"),
                F.lit(kind).alias("kind"),
                F.get(p["values"], i).alias("value"),
            )
            spans = F.concat(acc["spans"], F.array(span))
            if least is not None:
                spans = F.when(F.get(p["size"], i) >= least, spans).otherwise(acc["spans"])
            return F.struct(stop.cast("bigint").alias("pos"), spans.alias("spans"))

        indices = F.when(
            F.size(p["values"]) > 0, F.sequence(F.lit(0), F.size(p["values"]) - 1)
        ).otherwise(F.array().cast("array<int>"))
        return F.aggregate(indices, step, add, lambda acc: acc["spans"])

    packed = F.struct(*[c.alias(k) for k, c in parts.items()])
    return F.get(F.transform(F.array(packed), walk), F.lit(0))


def when_rlike(text: Column, gate: Column, spans: Column) -> Column:
    """The spans where the cheap test says that there may be any."""
    return F.when(gate, spans).otherwise(F.array().cast(SPAN))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the normal distribution (erfc by a rational approximation, error 1e-7)."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.3275911 * x)
    poly = t * (
        0.254829592
        + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))
    )
    return F.least(F.lit(1.0), poly * F.exp(-x * x))


def encoding_of(value: Column) -> Column:
    """The smallest alphabet that holds the token (padding and url-safe signs set aside)."""
    core = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")
    return (
        F.when(core.rlike("^[0-9a-f]+$"), "hex")
        .when(F.lower(core).rlike("^[0-9a-f]+$") & ~core.rlike("[a-f]"), "hex")
        .when(core.rlike("^[A-Z2-7]+$"), "base32")
        .when(core.rlike("^[A-Za-z0-9]+$"), "alnum")
        .otherwise("base64")
    )


def p_random(value: Column, encoding: Column) -> Column:
    """p-value of "independent uniform draws from the alphabet": three tests, Bonferroni."""
    alphabet = F.lit("")
    size = F.lit(1.0)
    for name, letters in ALPHABETS.items():
        alphabet = F.when(encoding == name, F.lit(letters)).otherwise(alphabet)
        size = F.when(encoding == name, F.lit(float(len(letters)))).otherwise(size)
    core = F.translate(F.rtrim(value, F.lit("=")), "-_", "+/")
    core = F.when(encoding == "hex", F.lower(core)).otherwise(core)
    codes = F.transform(
        F.split(core, ""), lambda c: (F.instr(alphabet, c) - 1).cast("double")
    )
    codes = F.filter(codes, lambda x: x >= 0)
    shape = F.struct(codes.alias("x"), size.alias("a"))

    def tests(s: Column) -> Column:
        x, a = s["x"], s["a"]
        n = F.size(x).cast("double")
        counts = F.transform(
            F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double")
        )
        squares = F.aggregate(counts, F.lit(0.0), lambda t, c: t + c * c)
        # Sum of (count - n/a)^2 / (n/a) over the alphabet is a/n * sum(count^2) - n, whose
        # mean is a - 1 and whose variance is 2 (a - 1) (n - 1) / n under the hypothesis.
        chi = squares * a / n - n
        z_chi = (chi - (a - 1.0)) / F.sqrt(2.0 * (a - 1.0) * (n - 1.0) / n)
        high = F.transform(x, lambda v: v >= a / 2.0)
        n1 = F.size(F.filter(high, lambda b: b)).cast("double")
        n0 = n - n1
        changes = F.size(
            F.filter(
                F.arrays_zip(
                    F.slice(high, F.lit(1), F.size(high) - 1).alias("l"),
                    F.slice(high, F.lit(2), F.size(high) - 1).alias("r"),
                ),
                lambda q: q["l"] != q["r"],
            )
        ).cast("double")
        mean_runs = 2.0 * n0 * n1 / n + 1.0
        var_runs = (mean_runs - 1.0) * (mean_runs - 2.0) / (n - 1.0)
        z_runs = F.when(var_runs > 0, (changes + 1.0 - mean_runs) / F.sqrt(var_runs)).otherwise(
            F.sqrt(n)
        )
        mean = F.aggregate(x, F.lit(0.0), lambda t, v: t + v) / n
        var = F.aggregate(x, F.lit(0.0), lambda t, v: t + (v - mean) * (v - mean))
        lagged = F.aggregate(
            F.zip_with(
                F.slice(x, F.lit(1), F.size(x) - 1),
                F.slice(x, F.lit(2), F.size(x) - 1),
                lambda u, v: (u - mean) * (v - mean),
            ),
            F.lit(0.0),
            lambda t, v: t + v,
        )
        z_serial = F.when(var > 0, (lagged / var + 1.0 / n) * F.sqrt(n)).otherwise(F.sqrt(n))
        # Too even is no sign against a secret, so that chi-squared is one-sided.
        p_chi = F.when(z_chi > 0, normal_tail(z_chi)).otherwise(1.0)
        return F.least(
            F.lit(1.0), 3.0 * F.least(p_chi, normal_tail(z_runs), normal_tail(z_serial))
        )

    return F.get(F.transform(F.array(shape), tests), F.lit(0))


def ordered(spans: Column) -> Column:
    return F.array_sort(spans)


def joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(
                ":", s["kind"], s["start"].cast("string"), s["stop"].cast("string")
            ),
        ),
        ",",
    )


def spans_of(docs: DataFrame, text: str = "`text`") -> DataFrame:
    """Adds `_base` (base spans) and `_tokens` (candidates with encoding, length class and p)."""
    t = F.coalesce(F.col(text), F.lit(""))
    low = F.lower(t)
    keyword = F.lit(False)
    for part in ("passw", "secret", "token", "api"):
        keyword = keyword | low.contains(part)
    gated = once(
        docs,
        _t=t,
        _assign=keyword,
        _access=t.contains("AKIA"),
        _hex=t.rlike(HEX),
        _long=t.rlike(CANDIDATE),
    )
    c = F.col
    raw = once(
        gated,
        _base=ordered(
            F.concat(
                when_rlike(c("_t"), c("_assign"), found(c("_t"), ASSIGN, "assign", 0, ASSIGN_LEAST)),
                when_rlike(c("_t"), c("_access"), found(c("_t"), ACCESS, "access", 1)),
                when_rlike(c("_t"), c("_hex"), found(c("_t"), HEX, "hex", 2)),
            )
        ),
        _runs=when_rlike(c("_t"), c("_long"), found(c("_t"), CANDIDATE, "random", 3)),
    ).drop("_t", "_assign", "_access", "_hex", "_long")
    outside = F.filter(
        c("_runs"),
        lambda s: s["value"].rlike("[0-9]")
        & s["value"].rlike("[A-Za-z]")
        & ~F.exists(c("_base"), lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])),
    )
    tokens = F.transform(
        outside,
        lambda s: F.struct(
            s["start"].alias("start"),
            s["stop"].alias("stop"),
            s["rank"].alias("rank"),
            encoding_of(s["value"]).alias("encoding"),
            F.floor(F.log2((s["stop"] - s["start"]).cast("double"))).cast("int").alias("size"),
            p_random(s["value"], encoding_of(s["value"])).alias("p"),
        ),
    )
    return once(raw, _tokens=tokens).drop("_runs")


def limits(scanned: DataFrame) -> DataFrame:
    """Per encoding and length class: p-values up to `limit` are discoveries of non-random tokens.

    Step-up procedure on counts in bins of -log2 p: a few rows per class, whatever the input.
    """
    p_bin = F.least(F.lit(P_BINS), F.floor(-F.log2(F.greatest(F.col("p"), F.lit(1e-30)))).cast("int"))
    counted = (
        scanned.select(F.explode("_tokens").alias("s"))
        .select("s.encoding", "s.size", "s.p")
        .withColumn("bin", p_bin)
        .groupBy("encoding", "size", "bin")
        .agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("p"))
    )
    by_class = Window.partitionBy("encoding", "size")
    up = by_class.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.select(
        "encoding",
        "size",
        "p",
        F.sum("n").over(up).alias("rank"),
        F.sum("n").over(by_class).alias("all"),
    )
    passed = F.col("p") <= DISCOVERY_RATE * F.col("rank") / F.col("all")
    return ranked.groupBy("encoding", "size").agg(
        F.max(F.when(passed, F.col("p")).otherwise(-1.0)).alias("limit")
    )


def with_secrets(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """Adds `secret_spans`: base spans and the candidates that stayed random, by start and kind."""
    # At most 4 encodings times 32 length classes: one row of bounded size.
    known = limits(scanned).agg(
        F.map_from_entries(
            F.collect_list(
                F.struct(F.concat_ws(":", "encoding", F.col("size").cast("string")), F.col("limit"))
            )
        ).alias("_limits")
    )
    kept = F.transform(
        F.filter(
            F.col("_tokens"),
            lambda s: s["p"]
            > F.coalesce(
                F.col("_limits")[F.concat_ws(":", s["encoding"], s["size"].cast("string"))],
                F.lit(-1.0),
            ),
        ),
        lambda s: F.struct(
            s["start"].alias("start"),
            s["rank"].alias("rank"),
            s["stop"].alias("stop"),
            F.lit("random").alias("kind"),
            s["encoding"].alias("value"),
        ),
    )
    return (
        docs.withColumn("_limits", known.scalar())
        .withColumn("secret_spans", F.array_sort(F.concat(F.col("_base"), kept)))
        .drop("_limits", "_tokens")
    )


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its id, `base_spans` and all `secret_spans`.

    A span has start, stop (code points, stop exclusive), rank, kind (assign, access, hex,
    or random for a token found by the test battery) and value (the matched text, or the
    inferred encoding of a random token).
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scanned = written(spans_of(slim).drop("text"), "secret-spans")
    return with_secrets(scanned, scanned).withColumnRenamed("_base", "base_spans")


def redact_secrets(docs: DataFrame, text: str = "text", mask: str = MASK) -> DataFrame:
    """The same rows and columns; secrets in the text are replaced by `mask`.

    Overlapping spans become one mask. Null text stays null.
    """
    # The row is packed, so that none of its columns can clash with the added ones.
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
    scanned = written(spans_of(packed, f"row.`{text}`"), "secret-docs")
    marked = with_secrets(scanned, scanned)
    whole = f"row.`{text}`"
    start = F.expr("struct(cast(0 as bigint) as pos, cast(array() as array<string>) as out)")

    def cut(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col(whole), (acc["pos"] + 1).cast("int"), (s["start"] - acc["pos"]).cast("int"))
        fresh = F.struct(s["stop"].alias("pos"), F.concat(acc["out"], F.array(gap, F.lit(mask))).alias("out"))
        wider = F.struct(F.greatest(acc["pos"], s["stop"]).alias("pos"), acc["out"].alias("out"))
        return F.when((s["start"] < acc["pos"]), wider).otherwise(fresh)

    clean = F.aggregate(
        F.col("secret_spans"),
        start,
        cut,
        lambda acc: F.concat(
            F.array_join(acc["out"], ""),
            F.substring(F.col(whole), (acc["pos"] + 1).cast("int"), F.length(whole)),
        ),
    )
    clean = F.when(F.size("secret_spans") > 0, clean).otherwise(F.col(whole))
    return marked.withColumn("_clean", clean).select(
        *[
            (F.col("_clean") if c == text else F.col(f"row.`{c}`")).alias(c)
            for c in columns
        ]
    )


def op2_secret_scan(docs: DataFrame) -> DataFrame:
    """Counts and span digests by document."""
    count = lambda kind: F.size(F.filter("base_spans", lambda s: s["kind"] == kind)).cast("long")
    return scan_secrets(docs).select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base_spans")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )
