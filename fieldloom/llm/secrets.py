"""Secret spans, and how widely each candidate value is owned across the corpus.

Three fixed patterns give the base spans of a text. The ownership method adds spans: further random-looking
tokens count as secrets (kind ``owned``) if the corpus shows them with few owners. Every candidate
value is counted, by hash, over distinct repositories and owners; a value held by more than ``max_owners``
owners is a widely copied example, the others look live.

Only DataFrame functions are used. Spans come from splitting a text by a pattern: the pieces and the
matches alternate, so running sums of their lengths are the positions. Hot values are reduced to one row
per (value, owner, repository), then per (value, owner), before they are counted.

Definitions: a null text is empty; null owners and repositories count as one more owner or repository; rows
equal in id and text share their spans and are returned row by row; of overlapping candidates an
``owned`` one gives way to a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .text import free_name

#: Fixed patterns, in their order. The first is kept if group 2 has 6 characters.
KINDS = ("assign", "access", "hex", "owned")
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
#: Cheap tests that a text must pass to have a match at all.
ASSIGN_HINT = r"(?i:passw|secret|token|api_?key)"


def matches(text: Column, kind: int, pattern: str, keep_group: int = 0, keep_chars: int = 0) -> Column:
    """Spans (start, kind, end, value) of the non-overlapping matches, positions in code points.

    The value is the last group asked for. Greedy runs of at least n characters match exactly where
    matches of one or more characters of at least that length do, as a run always ends at the same place.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(keep_group))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), whole.alias("m"), value.alias("v"))
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), nothing.alias("out"))

    def step(acc, z):
        start = acc["at"] + F.length(z["p"])
        end = start + F.coalesce(F.length(z["m"]), F.lit(0))
        good = z["m"].isNotNull() & (F.length(z["v"]) >= keep_chars)
        one = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), z["v"].alias("value")))
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, begin, step, lambda acc: acc["out"])


def _none() -> Column:
    return F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")


def _overlaps(span: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (span["start"] < b["end"]) & (b["start"] < span["end"]))


def candidates(docs: DataFrame, doc_id: str, text: str, owner: list[str], repo: list[str]) -> DataFrame:
    """One row per row: id, text hash, owner and repository hashes, base spans, further candidates."""
    t = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"),
                       F.xxhash64(*owner).alias("owner"), F.xxhash64(*owner, *repo).alias("repo"), t.alias("t"))
    t = F.col("t")
    spans = slim.select(
        "doc_id", "text_hash", "owner", "repo",
        F.concat(F.when(t.rlike(ASSIGN_HINT), matches(t, 0, ASSIGN, 2, 6)).otherwise(_none()),
                 F.when(F.contains(t, F.lit("AKIA")), matches(t, 1, ACCESS)).otherwise(_none()),
                 F.when(t.rlike(HEX), matches(t, 2, HEX)).otherwise(_none())).alias("base"),
        F.when(t.rlike(TOKEN), matches(t, 3, TOKEN)).otherwise(_none()).alias("tokens"))
    looks_random = lambda s: (
        s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]")
        & (F.size(F.array_distinct(F.split(s["value"], ""))) >= 10))
    return spans.withColumn(
        "base", F.array_sort("base")).withColumn(
        "more", F.filter("tokens", lambda s: looks_random(s) & ~_overlaps(s, F.col("base")))).drop("tokens")


def ownership(found: DataFrame) -> DataFrame:
    """(value_hash, owners, repos) of every candidate value."""
    values = found.select("owner", "repo", F.explode(F.concat("base", "more")).alias("s"))
    values = values.select("owner", "repo", F.xxhash64(F.col("s")["value"]).alias("value_hash"))
    repos = values.groupBy("value_hash", "owner", "repo").agg(F.lit(1).alias("one"))
    owners = repos.groupBy("value_hash", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return owners.groupBy("value_hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repos").alias("repos"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", owner: list[str] = ("source",),
         repo: list[str] = ("lang",), max_owners: int = 1, max_repos: int = 2) -> DataFrame:
    """doc_id and spans (start, kind, end, value_hash, owners, repos, live), one row per row of ``docs``.

    A live value has at most ``max_owners`` owners and ``max_repos`` repositories.
    """
    found = stage(candidates(docs, doc_id, text, list(owner), list(repo)), "secret-candidates")
    holders = stage(ownership(found), "secret-owners")
    each = found.select("doc_id", "text_hash", F.explode(F.concat("base", "more")).alias("s")).distinct()
    each = each.withColumn("value_hash", F.xxhash64(F.col("s")["value"])).join(holders, "value_hash")
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos)
    s = F.col("s")
    each = each.withColumn("live", live).filter((s["kind"] != 3) | F.col("live"))
    spans = each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_list(F.struct(
        s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"),
        "value_hash", "owners", "repos", "live"))).alias("spans"))
    some = found.filter(F.size("base") + F.size("more") > 0).select("doc_id", "text_hash")
    i, h = free_name(some, "_i"), free_name(some, "_h")
    spans = spans.withColumnsRenamed({"doc_id": i, "text_hash": h})
    hit = some.join(spans, F.col("doc_id").eqNullSafe(F.col(i)) & (F.col("text_hash") == F.col(h)), "left").select("doc_id", "spans")
    rest = found.filter(F.size("base") + F.size("more") == 0).select("doc_id", F.lit(None).cast(hit.schema["spans"].dataType).alias("spans"))
    out = hit.unionByName(rest)
    return out.withColumn("spans", F.coalesce("spans", F.array().cast(hit.schema["spans"].dataType)))


def span_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(spans: DataFrame) -> DataFrame:
    """The per-document report: counts by kind, hash of the base spans, all spans as text."""
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    tally = lambda test: F.size(F.filter("spans", test)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] < 3)
    return spans.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(span_text(base), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"),
        tally(lambda s: s["live"]).alias("n_live"), tally(lambda s: ~s["live"]).alias("n_copied"))
