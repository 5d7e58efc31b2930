"""Secret scan with multipart credential linking, in DataFrame functions only.

Strong kinds are reported wherever they stand: ``assign`` (a named value of 12 or more characters),
``access`` (a cloud access key id) and ``hex`` (16 or more hexadecimal digits). Weak candidates are ``secret`` (a named value of 4
to 11 characters, or 40 base64 characters of mixed kinds), ``login`` (a named user or client) and ``endpoint``
(a URL's host or a named host). Parts have a role: identifier (access, login), secret (assign, secret) or
endpoint. A scope reaches ``SCOPE`` code points to either side of a part's start. A weak secret is reported if an identifier
stands in its scope, a login if a secret does, an endpoint if both do.

The interval join runs on tiles of ``SCOPE`` code points: for each document, tile and role only the
first and the last start are kept, and a part meets its own tile and both neighbours, so no pairs arise.

Spans are [start, end) in code points. Defined results: a null or empty text has no spans. Repeated
rows of the same id and text get the same spans; a null id is scanned as any other. An empty table gives
an empty result. Texts are scanned whole. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylva.llm.common import pick

# The patterns of the strong kinds, and the names that mark weak ones.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
RUN40 = r"[A-Za-z0-9+/]{40,}"
LOGIN = r"""(?i:user(?:name)?|login|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
ENDPOINT = r"""https?://[A-Za-z0-9.-]+(?::[0-9]+)?|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9.:/_-]{4,}"""
KINDS = ("assign", "access", "hex", "secret", "login", "endpoint")
STRONG = KINDS[:3]
SCOPE = 256
MASK = "[SECRET]"


def _found(pattern: str, kind: str, text: Column) -> Column:
    """All matches of a pattern in order, as structs (kind, gap before, length, length of the value, mixed)."""
    re = F.lit(pattern)
    gaps = F.split(text, pattern, -1)
    whole = F.regexp_extract_all(text, re, F.lit(0))
    value = F.regexp_extract_all(text, re, F.lit(1 if kind == "assign" else 0))
    zipped = F.arrays_zip(gaps.alias("g"), whole.alias("w"), value.alias("v"))
    structs = F.transform(
        F.filter(zipped, lambda x: x["w"].isNotNull()),
        lambda x: F.struct(
            F.lit(kind).alias("kind"),
            F.length(x["g"]).cast("long").alias("gap"),
            F.length(x["w"]).cast("long").alias("len"),
            F.length(x["v"]).cast("long").alias("value"),
            (x["w"].rlike("[A-Z]") & x["w"].rlike("[a-z]") & x["w"].rlike("[0-9]")).alias("mixed"),
        ),
    )
    return F.when(text.rlike(pattern), structs)


PATTERNS = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "run": RUN40, "login": LOGIN, "endpoint": ENDPOINT}
_EMPTY = "array<struct<kind:string,gap:bigint,len:bigint,value:bigint,mixed:boolean>>"


def parts(rows: DataFrame) -> DataFrame:
    """(id, text hash, kind, start, end) of every strong span and weak candidate; one row for repeated documents."""
    text = F.col("text")
    any_kind = F.flatten(F.array(*[F.coalesce(_found(p, k, text), F.array().cast(_EMPTY)) for k, p in PATTERNS.items()]))
    each = rows.where("text is not null").select("id", F.xxhash64("text").alias("h"), F.posexplode(any_kind).alias("at", "p")).select("id", "h", "at", "p.*").distinct()
    run = F.sum(F.col("gap") + F.col("len")).over(Window.partitionBy("id", "h", "kind").orderBy("at"))
    each = each.withColumn("end", run).withColumn("start", F.col("end") - F.col("len"))
    kind = (
        F.when(F.col("kind") == "assign", F.when(F.col("value") >= 12, "assign").when(F.col("value") >= 4, "secret"))
        .when(F.col("kind") == "run", F.when((F.col("len") == 40) & F.col("mixed"), "secret"))
        .otherwise(F.col("kind"))
    )
    return each.withColumn("kind", kind).where("kind is not null").select("id", "h", "kind", "start", "end")


def _role(kind: Column) -> Column:
    return F.when(kind.isin("access", "login"), "i").when(kind.isin("assign", "secret"), "s").when(kind == "endpoint", "e")


def linked(found: DataFrame) -> DataFrame:
    """The strong parts, and the weak ones with their complementary parts in scope."""
    tile = F.floor(F.col("start") / SCOPE)
    placed = found.withColumn("role", _role(F.col("kind"))).withColumn("tile", tile)
    tiles = placed.where("role in ('i', 's')").groupBy("id", "h", "tile", "role").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
    weak = placed.where(~F.col("kind").isin(*STRONG)).withColumnRenamed("role", "own").withColumn("tile", F.explode(F.array(F.col("tile") - 1, F.col("tile"), F.col("tile") + 1)))
    w, t = weak.alias("w"), tiles.alias("t")
    near = F.col("t.lo").between(F.col("w.start") - SCOPE, F.col("w.start") + SCOPE) | F.col("t.hi").between(F.col("w.start") - SCOPE, F.col("w.start") + SCOPE)
    met = w.join(t, F.col("w.id").eqNullSafe(F.col("t.id")) & (F.col("w.h") == F.col("t.h")) & (F.col("w.tile") == F.col("t.tile")) & (F.col("w.own") != F.col("t.role")) & near)
    kept = (
        met.groupBy("w.id", "w.h", "w.kind", "w.start", "w.end")
        .agg(F.max((F.col("t.role") == "i").cast("int")).alias("i"), F.max((F.col("t.role") == "s").cast("int")).alias("s"))
        .where("(kind = 'secret' and i = 1) or (kind = 'login' and s = 1) or (kind = 'endpoint' and i = 1 and s = 1)")
        .select("id", "h", "kind", "start", "end")
    )
    return found.where(F.col("kind").isin(*STRONG)).unionByName(kept)


def spans_by_document(rows: DataFrame) -> DataFrame:
    """(id, h, spans): spans sorted by start, then kind as listed, for documents that have any."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return (
        linked(parts(rows))
        .groupBy("id", "h")
        .agg(F.array_sort(F.collect_list(F.struct("start", order.alias("order"), "end", "kind"))).alias("spans"))
    )


def _text_of(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))


def _with_spans(rows: DataFrame) -> DataFrame:
    own = rows.withColumn("h", F.xxhash64("text")).alias("d")
    s = spans_by_document(rows).alias("s")
    return own.join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.h") == F.col("s.h")), "left").select("d.*", F.coalesce("s.spans", F.array().cast("array<struct<start:bigint,order:bigint,end:bigint,kind:string>>")).alias("spans"))


def scan(docs: DataFrame, *, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The id, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (digest of the strong spans), ``spans`` and ``n_linked``."""
    rows = pick(docs, row_id, text).toDF("id", "text")
    own = rows.select("id", F.xxhash64("text").alias("h")).alias("d")
    s = spans_by_document(rows).select("id", "h", "spans").alias("s")
    out = own.join(s, F.col("d.id").eqNullSafe(F.col("s.id")) & (F.col("d.h") == F.col("s.h")), "left").select(F.col("d.id").alias(row_id), "s.spans")
    count = lambda *kinds: F.coalesce(F.size(F.filter("spans", lambda x: x["kind"].isin(*kinds))), F.lit(0)).cast("long")
    none = F.col("spans").isNull()
    count_or_0 = lambda *kinds: F.when(none, F.lit(0).cast("long")).otherwise(count(*kinds))
    base = F.when(none, "").otherwise(_text_of(F.filter("spans", lambda x: x["kind"].isin(*STRONG))))
    return out.select(
        row_id,
        *[count_or_0(k).alias(f"n_{k}") for k in STRONG],
        F.sha2(base, 256).alias("base_sha256"),
        F.when(none, "").otherwise(_text_of(F.col("spans"))).alias("spans"),
        count_or_0(*KINDS[3:]).alias("n_linked"),
    )


def redact(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text and any others) with every reported span of the text replaced by a mask."""
    marked = _with_spans(rows)
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        kept = F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mask = F.when(s["start"] >= acc["at"], MASK).otherwise("")
        return F.struct(F.greatest(s["end"], acc["at"]).alias("at"), F.concat(acc["out"], kept, mask).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), F.length("text"))))
    return marked.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).drop("h", "spans")
