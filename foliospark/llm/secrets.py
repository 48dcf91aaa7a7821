"""Secret scan with corpus-wide ownership frequency.

Base spans follow three fixed patterns. Beside them, long mixed tokens are candidates. Every value, base or candidate,
is counted over the corpus by distinct repositories and owners: what many owners hold is a copied example, what one
owner holds looks live. Live candidates that no base span covers are added as spans of kind ``owned``.

Defined results: a null text is empty and has no spans; a null owner or repository counts as one unnamed owner or
repository; spans are in code points, end exclusive, by (start, kind in the order assign, access, hex, owned); rows with
the same ``doc_id`` are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize

# fixed values: the base patterns; a keyword's letters are spelled in both cases, as case folding differs by engine
ASSIGN = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ACCESS, HEX = "AKIA[A-Z0-9]{16,}", "[0-9a-f]{24,}"
#: Maximal runs; the guard only spares the engine starts inside a run.
TOKEN = "(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "owned")
#: A candidate token has a digit, a letter and this many different characters.
MIN_DISTINCT = 10
#: Spans that are scanned together, so that the work on a text grows with its hits and not with their square.
BLOCK = 512


def _numbers(block: Column, n: Column) -> Column:
    """The places from 0 to n - 1 that lie in a block."""
    return F.sequence(block * BLOCK, F.least(block * BLOCK + (BLOCK - 1), n - 1))


def _spans(text: Column, kind: str, pattern: str, value_group: int = 0) -> Column:
    """Leftmost non-overlapping matches as array<struct<start,kind_no,kind,end,value>>, from the matches and what is between."""
    empty = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string>>")
    parts = F.struct(
        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(value_group)).alias("v"),
        F.split(text, pattern, -1).alias("s"),
    )

    def place(p: Column) -> Column:
        def size(i: Column) -> Column:
            return (F.length(F.get(p["s"], i)) + F.length(F.get(p["m"], i))).cast("long")

        def step(acc: Column, i: Column) -> Column:
            start = acc["pos"] + F.length(F.get(p["s"], i))
            end = start + F.length(F.get(p["m"], i))
            one = F.struct(start.alias("start"), F.lit(KINDS.index(kind)).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), F.get(p["v"], i).alias("value"))
            return F.struct(end.alias("pos"), F.array_append(acc["out"], one).alias("out"))

        def within(b: Column, begin: Column) -> Column:
            return F.aggregate(_numbers(b, F.size(p["m"])), F.struct(begin.alias("pos"), empty.alias("out")), step, lambda a: a["out"])

        # an array that grows is copied with each element, so only arrays of BLOCK grow: where blocks begin, then each block
        blocks = F.sequence(F.lit(0), F.floor((F.size(p["m"]) - 1) / BLOCK).cast("int"))
        totals = F.transform(blocks, lambda b: F.aggregate(_numbers(b, F.size(p["m"])), F.lit(0).cast("long"), lambda a, i: a + size(i)))
        begins = F.aggregate(totals, F.array(F.lit(0).cast("long")), lambda a, n: F.array_append(a, F.element_at(a, -1) + n))
        found = F.get(F.transform(F.array(begins), lambda at: F.flatten(F.transform(blocks, lambda b: within(b, F.get(at, b))))), F.lit(0))
        return F.when(F.size(p["m"]) == 0, empty).otherwise(found)

    # a struct bound to a lambda variable is computed once
    return F.when(text.rlike(pattern), F.flatten(F.transform(F.array(parts), place))).otherwise(empty)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``_base`` and ``_token``: the spans of the base kinds, and of the candidate tokens outside them."""
    t = F.coalesce(F.col(text), F.lit(""))
    found = docs.withColumn("_assign", F.filter(_spans(t, "assign", ASSIGN, 2), lambda x: F.length(x["value"]) >= 6))
    found = found.withColumn("_access", _spans(t, "access", ACCESS)).withColumn("_hex", _spans(t, "hex", HEX)).withColumn("_any", _spans(t, "owned", TOKEN))
    found = found.withColumn("_base", F.array_sort(F.concat("_assign", "_access", "_hex")))

    def mixed(x: Column) -> Column:
        v = x["value"]
        return v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(v, ""))) >= MIN_DISTINCT)

    def block(b: Column) -> Column:
        spans = F.slice("_base", b * BLOCK + 1, BLOCK)
        return F.struct(F.array_min(F.transform(spans, lambda x: x["start"])).alias("start"), F.array_max(F.transform(spans, lambda x: x["end"])).alias("end"), spans.alias("spans"))

    # spans are sorted, so a token meets one or two blocks of them
    blocks = F.when(F.size("_base") > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size("_base") - 1) / BLOCK).cast("int")), block))
    meets = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])

    def free(b: Column) -> Column:
        return F.filter("_mixed", lambda x: ~F.coalesce(F.exists(b, lambda y: meets(y, x) & F.exists(y["spans"], lambda z: meets(z, x))), F.lit(False)))

    found = found.withColumn("_mixed", F.filter("_any", mixed))
    return found.withColumn("_token", F.when(F.size("_mixed") == 0, F.col("_mixed")).otherwise(F.flatten(F.transform(F.array(blocks), free)))).drop("_any", "_mixed", "_assign", "_access", "_hex")


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), max_owners: int = 1) -> DataFrame:
    """One row a document: ``doc_id``, ``base`` and ``spans`` (array<struct<start,kind_no,kind,end,value,n_owners,n_repositories,live>>).

    ``owner`` and ``repository`` name the columns that tell who holds a text. A value with at most ``max_owners``
    owners is live.
    """
    repo = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repository])
    mine = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("_owner"), repo.alias("_repo"))
    scanned = scan(mine).select(F.monotonically_increasing_id().alias("_row"), "doc_id", "_owner", "_repo", F.array_sort(F.concat("_base", "_token")).alias("_all"))
    rows = materialize(scanned)  # spans only, no text: the texts are scanned once
    each = rows.select("_row", "_owner", "_repo", F.explode("_all").alias("_s")).withColumn("_key", F.sha2(F.col("_s.value"), 256))
    # distinct first, so a value that very many documents hold reaches its counter as one row an owner and repository
    held = each.select("_key", "_owner", "_repo").distinct().groupBy("_key").agg(F.countDistinct("_owner").alias("n_owners"), F.count(F.lit(1)).alias("n_repositories"))
    held = materialize(held)
    judged = each.join(held, "_key").select("_row", F.struct("_s.start", "_s.kind_no", "_s.kind", "_s.end", "_s.value", "n_owners", "n_repositories", (F.col("n_owners") <= max_owners).alias("live")).alias("_j"))
    by_row = judged.groupBy("_row").agg(F.array_sort(F.collect_list("_j")).alias("_found"))
    none = F.array().cast("array<struct<start:bigint,kind_no:int,kind:string,end:bigint,value:string,n_owners:bigint,n_repositories:bigint,live:boolean>>")
    out = rows.select("_row", "doc_id").join(by_row, "_row", "left").withColumn("_found", F.coalesce("_found", none))
    return out.select("doc_id", F.filter("_found", lambda x: x["kind"] != "owned").alias("base"), F.filter("_found", lambda x: (x["kind"] != "owned") | x["live"]).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
