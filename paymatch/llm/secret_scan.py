"""Secret scans (operator 2): corpus-wide ownership frequency of candidate hashes, in DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

#: The kinds in order, their patterns, the group that holds the secret and its least length.  For `access` and
#: `hex` the least length is inside the pattern, which finds the same matches: a shorter run cannot hold a longer one.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Further candidates of the method: long tokens that mix digits with letters of both cases.
TOKEN = ("owned", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)

BLOCK = 1024  # code points of a text's blocks, from which pieces are cut


def _hits(text: Column, rank: int, kind: tuple[str, str, int, int]) -> Column:
    """The leftmost non-overlapping matches, each with the code points between the match before and it, its own, and whether
    its secret is one: long enough, and for further candidates of mixed characters."""
    name, pattern, group, least = kind
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    secret = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.arrays_zip(F.slice(F.split(text, pattern, -1), 1, F.size(whole)).alias("gap"), whole.alias("hit"), secret.alias("secret"))

    def hit(x, place):
        good = F.length(x["secret"]) >= least
        if rank == len(KINDS):
            good &= x["secret"].rlike("[0-9]") & x["secret"].rlike("[a-z]") & x["secret"].rlike("[A-Z]")
        return F.struct(F.lit(rank).alias("rank"), place.alias("place"), F.lit(name).alias("kind"), F.length(x["gap"]).alias("gap"),
                        F.length(x["hit"]).alias("size"), F.xxhash64(x["secret"]).alias("hash"), good.alias("good"))

    return F.when(text.rlike(pattern), F.transform(steps, hit))


def joined(spans: Column) -> Column:
    """kind:start:end of spans that are sorted by start and kind, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def candidates(docs: DataFrame, keep: list[str], owner: str | None = "source", repository: str | None = "lang") -> tuple[DataFrame, DataFrame]:
    """(rows, spans), both staged: (row, doc) with the columns `keep` of each row of `docs` in a struct, and for each span of the listed
    kinds and each further candidate that overlaps none of them (row, owner, repo, span).

    A repository is named within its owner; a missing column or a null is one nameless owner or repository.  Positions are
    running sums over a row's matches, and overlaps are found in two sorted passes, so the work grows with a text's length
    whatever it holds.
    """
    name = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) if c in docs.columns else F.lit("")
    found = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("doc"), name(owner).alias("owner"), name(repository).alias("repo"),
                        F.coalesce("text", F.lit("")).alias("_text"))
    hits = [_hits(F.col("_text"), i, kind) for i, kind in enumerate((*KINDS, TOKEN))]
    rows = stage(found.select(F.monotonically_increasing_id().alias("row"), "doc", "owner", "repo", *(h.alias(f"hits{i}") for i, h in enumerate(hits))))
    each = functools.reduce(DataFrame.union, (rows.select("row", "owner", "repo", F.explode(f"hits{i}").alias("x")) for i in range(len(hits))))
    each = each.select("row", "owner", "repo", "x.*").repartition("row")
    end = F.sum(F.col("gap") + F.col("size")).over(W.partitionBy("row", "rank").orderBy("place").rowsBetween(W.unboundedPreceding, 0)).cast("int")
    placed = each.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).where("good")
    base = F.col("rank") < len(KINDS)
    reached = F.max(F.when(base, F.col("end"))).over(W.partitionBy("row").orderBy("start", F.desc(base)).rowsBetween(W.unboundedPreceding, 0))
    following = F.min(F.when(base, F.col("start"))).over(W.partitionBy("row").orderBy(F.desc("start"), F.desc(base)).rowsBetween(W.unboundedPreceding, 0))
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))
    spans = (placed.withColumns({"reached": reached, "following": following}).where(base | free)
             .select("row", "owner", "repo", F.struct("start", "rank", "kind", "end", "hash").alias("span")))
    return rows.select("row", "doc"), stage(spans)


def ownership(spans: DataFrame) -> DataFrame:
    """Rows (hash, n_owners, n_repos): in how many owners' and repositories' texts each candidate occurs."""
    return (spans.select("owner", "repo", F.col("span.hash").alias("hash")).distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
            .groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("n").alias("n_repos")))


def classified(spans: DataFrame, copied_owners: int = 3, copied_repos: int = 6) -> DataFrame:
    """`spans` with n_owners, n_repos and the booleans `live` and `example`; further candidates that are not live are left out.

    A candidate that `copied_owners` or more owners or `copied_repos` or more repositories hold is a copied example; one that
    a single owner holds in fewer repositories is live-looking.
    """
    extra = F.col("span.rank") == len(KINDS)
    many = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    known = spans.withColumn("hash", F.col("span.hash")).join(stage(ownership(spans)), "hash").drop("hash")
    known = known.withColumns({"example": many & ~extra, "live": (F.col("n_owners") == 1) & ~many})
    return known.where(~extra | F.col("live"))


def scan(docs: DataFrame, owner: str | None = "source", repository: str | None = "lang", copied_owners: int = 3, copied_repos: int = 6) -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, n_repos), one for each row of `docs`.

    Positions are code points, ends exclusive.  n_repos is the largest number of repositories that hold one of the spans'
    secrets.  A null text is empty: no spans, the digest of the empty text.  Repeated rows get a row each and count as one
    repository; an empty table gives no rows; columns other than doc_id, text, owner and repository are ignored.
    """
    rows, spans = candidates(docs, ["doc_id"], owner, repository)
    base = F.col("span.rank") < len(KINDS)
    held = classified(spans, copied_owners, copied_repos).groupBy("row").agg(
        F.sort_array(F.collect_list("span")).alias("all"), F.sort_array(F.collect_list(F.when(base, F.col("span")))).alias("base"),
        *(F.count(F.when(F.col("span.rank") == i, 1)).alias(f"n_{kind[0]}") for i, kind in enumerate(KINDS)),
        F.count(F.when(F.col("live"), 1)).alias("n_live"), F.count(F.when(F.col("example"), 1)).alias("n_example"), F.max("n_repos").alias("n_repos"))
    held = held.select("row", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("all")).alias("spans"), *(c for c in held.columns if c[:2] == "n_"))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(held, "row", "left").select(
        "doc.doc_id", *(none(f"n_{kind[0]}") for kind in KINDS), F.coalesce("base_sha256", F.sha2(F.lit(""), 256)).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), none("n_live"), none("n_example"), none("n_repos"))


def _piece(start: Column, end: Column) -> Column:
    """Code points from `start` to before `end` of the text whose blocks are in the column `blocks`."""
    first = F.floor(start / BLOCK).cast("int")
    near = F.array_join(F.slice("blocks", first + 1, F.floor((end - 1) / BLOCK).cast("int") - first + 1), "")
    return F.when(end > start, F.substring(near, start - first * BLOCK + 1, end - start)).otherwise("")


def redact(docs: DataFrame, owner: str | None = "source", repository: str | None = "lang", copied_owners: int = 3, copied_repos: int = 6,
           mark: str = "[SECRET]") -> DataFrame:
    """`docs` with every span but copied examples replaced by `mark` (overlapping ones by one mark), and n_chars to match.

    All rows and columns stay; null texts stay null.
    """
    rows, spans = candidates(docs, docs.columns, owner, repository)
    before = W.partitionBy("row").orderBy("span").rowsBetween(W.unboundedPreceding, -1)
    cuts = (classified(spans, copied_owners, copied_repos).where("not example").select("row", "span")
            .withColumn("at", F.coalesce(F.max("span.end").over(before), F.lit(0))))
    cuts = cuts.groupBy("row").agg(F.sort_array(F.collect_list(F.when(F.col("span.start") >= F.col("at"), F.struct("span.start", "at")))).alias("gaps"),
                                   F.max("span.end").alias("tail"))
    text = F.col("doc.text")
    clean = F.array_join(F.concat(F.transform("gaps", lambda g: _piece(g["at"], g["start"])), F.array(_piece(F.col("tail"), F.length(text)))), mark)
    out = (rows.join(cuts, "row", "left").withColumn("blocks", F.when(F.col("tail").isNotNull(), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))))
           .withColumn("clean", F.when(F.col("tail").isNull(), text).otherwise(clean)))
    change = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*((change[c] if c in change else F.col(f"doc.`{c}`")).alias(c) for c in docs.columns))
