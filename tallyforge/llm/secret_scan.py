"""Secret scans with corpus-wide ownership frequency (built-in functions only).

Candidates are found per document. Their hashes are then counted over the whole corpus by distinct
repositories and owners: a value that many owners hold, or many repositories of few owners, is a copied
example; any other is taken for a live credential of its owners. Opaque strings are too weak a sign alone
and become spans only if they are not copied.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable

#: The kinds in listing order with their pattern, the group that is the secret and its least length.
KINDS = (
    ("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("opaque", r"[A-Za-z0-9+/_=-]{20,}", 0, 20),
)
OPAQUE = len(KINDS) - 1
#: Values with at least so many owners, or repositories of whatever owners, are copied examples.
COPIED_OWNERS, COPIED_REPOS = 3, 6
PLACEHOLDER = "[SECRET]"
#: Characters of the pieces in which secrets are replaced.
PIECE = 4096


def _may_hold(text: Column) -> dict[str, Column]:
    """Cheap tests that every text with a match of the kind passes."""
    low = F.lower(text)
    named = F.lit(False)
    for part in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(low, F.lit(part))
    return {
        "assign": named,
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{24}"),
        "opaque": text.rlike("(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20}"),
    }


def _matches(text: Column, number: int) -> Column:
    """Matches of a kind, leftmost and non-overlapping: the length of the text before each, its own, and the secret.

    Split and extraction find the same matches; what follows the last one has no length.
    """
    _, pattern, group, _ = KINDS[number]
    whole = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda w: F.length(w))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    return F.zip_with(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)),
        F.arrays_zip(whole.alias("n"), value.alias("v")),
        lambda before, m: F.struct(F.lit(number).alias("kind"), before.alias("before"), m["n"].alias("n"), m["v"].alias("value")),
    )


def _opaque(v: Column) -> Column:
    """At least three digits and three letters."""
    return (F.length(F.regexp_replace(v, "[^0-9]", "")) >= 3) & (F.length(F.regexp_replace(v, "[^A-Za-z]", "")) >= 3)


def candidates(docs: DataFrame, text: str, owner: Column, repository: Column) -> tuple[DataFrame, DataFrame]:
    """Rows ``row, text, owner, repo`` that may hold a secret, and ``row, text`` of those that do not."""
    rows = docs.select(
        F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("text"), owner.alias("owner"), repository.alias("repo"))
    any_ = reduce(lambda a, b: a | b, _may_hold(F.col("text")).values())
    return rows.where(any_), rows.where(~any_).select("row", "text")


def spans(rows: DataFrame) -> DataFrame:
    """``rid, owner, repo, start, kind, end, value`` of all spans of rows with a ``rid``, ``end`` exclusive, in code points.

    Ends are running sums over the matches of a kind in a row. An opaque string that overlaps a span of
    another kind is none: the ends before it and the starts behind it tell.
    """
    none = F.expr("cast(array() as array<struct<kind:int,before:int,n:int,value:string>>)")
    tests = _may_hold(F.col("text"))
    found = F.concat(*[F.when(tests[k], _matches(F.col("text"), i)).otherwise(none) for i, (k, *_) in enumerate(KINDS)])
    each = rows.select("rid", "owner", "repo", F.posexplode(found).alias("pos", "m")).select("rid", "owner", "repo", "pos", "m.*")
    in_order = Window.partitionBy("rid", "kind").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    each = each.where("n is not null").repartition("rid").withColumn(
        "end", F.sum(F.col("before") + F.col("n")).over(in_order).cast("int")).withColumn("start", F.col("end") - F.col("n"))
    least = F.array(*[F.lit(k[-1]) for k in KINDS])
    each = each.where(F.length("value") >= F.get(least, F.col("kind")))
    base = F.col("kind") < OPAQUE
    ahead = Window.partitionBy("rid").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("ended", F.max(F.when(base, F.col("end"))).over(ahead)).withColumn(
        "next", F.min(F.when(base, F.col("start"))).over(behind))
    free = F.coalesce(F.col("ended") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    return each.where(base | (free & _opaque(F.col("value")))).select("rid", "owner", "repo", "start", "kind", "end", "value")


def ownership(hits: DataFrame) -> DataFrame:
    """Per candidate hash: rows, distinct repositories and distinct owners that hold it.

    Counted from the finest key up, so each step sums what map tasks have added up before; a value held
    by a third of all rows is one row per task. Null owners count as one owner.
    """
    fine = hits.groupBy(F.sha2("value", 256).alias("hash"), "owner", "repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = fine.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repos"), F.sum("n").alias("n"))
    return by_owner.groupBy("hash").agg(
        F.count(F.lit(1)).alias("n_owners"), F.sum("repos").alias("n_repos"), F.sum("n").alias("n_rows"))


def scan(docs: DataFrame, text: str = "text", owner: str | Column = "source", repository: str | Column = "source") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows that may hold a secret, the graded spans, and rows without any.

    The first has ``rid, row, text``; the second ``rid, start, kind`` (number), ``end, name, value, n_owners, n_repos,
    copied``; the third ``row, text``. First and third hold every row once. A value is copied if it has many
    owners or many repositories, be they of one owner; an opaque one is a span only if it is not. Null texts
    are empty; null owners are one owner.
    """
    owner, repository = (F.col(c) if isinstance(c, str) else c for c in (owner, repository))
    some, rest = candidates(docs, text, owner, repository)
    rows = durable(some.withColumn("rid", F.monotonically_increasing_id()))
    hits = durable(spans(rows))
    freq = ownership(hits).withColumn("copied", (F.col("n_owners") >= COPIED_OWNERS) | (F.col("n_repos") >= COPIED_REPOS))
    names = F.array(*[F.lit(k) for k, *_ in KINDS])
    graded = hits.withColumn("hash", F.sha2("value", 256)).join(freq, "hash").where((F.col("kind") < OPAQUE) | ~F.col("copied")).select(
        "rid", "start", "kind", "end", F.get(names, F.col("kind")).alias("name"), "value", "n_owners", "n_repos", "copied")
    return rows.select("rid", "row", "text"), durable(graded), rest


def report(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """One row per input row: counts per base kind, digest of the base spans, all spans, live and copied ones.

    ``most_owners`` and ``most_repos`` are those of its most widespread values, 0 without spans. An empty table
    gives no row, repeated rows give repeated results; other columns do not matter. Where a
    kind's counts are zero the digest is that of the empty string.
    """
    rows, graded, rest = scan(docs, **columns)
    listed = F.concat_ws(":", "name", "start", "end")

    def joined(test: Column) -> Column:
        each = F.array_sort(F.collect_list(F.when(test, F.struct("start", "kind", listed.alias("text")))))
        return F.array_join(F.transform(each, lambda s: s["text"]), ",")

    def count(test: Column) -> Column:
        return F.count(F.when(test, 1))

    found = graded.groupBy("rid").agg(
        *[count(F.col("kind") == i).alias(f"n_{k}") for i, (k, *_) in enumerate(KINDS[:OPAQUE])],
        joined(F.col("kind") < OPAQUE).alias("base"), joined(F.lit(True)).alias("spans"),
        count(~F.col("copied")).alias("n_owned"), count(F.col("copied")).alias("n_copied"),
        F.max("n_owners").alias("most_owners"), F.max("n_repos").alias("most_repos"))
    every = rows.select("rid", "row.doc_id").join(found, "rid", "left").unionByName(
        rest.select("row.doc_id"), allowMissingColumns=True)
    numbers = [f"n_{k}" for k, *_ in KINDS[:OPAQUE]], ["n_owned", "n_copied", "most_owners", "most_repos"]
    first, last = ([F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names] for names in numbers)
    return every.select(
        "doc_id", *first, F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"),
        F.coalesce("spans", F.lit("")).alias("spans"), *last)


def redact(docs: DataFrame, **columns: str | Column) -> DataFrame:
    """The rows with every live secret replaced by a placeholder; copied examples stay as they are.

    Of an assignment only the value goes; where secrets overlap, each goes from the end of those before it.
    ``n_chars`` is counted anew where the table has it. Texts are cut into pieces of ``PIECE`` characters and
    put together again, so a text with any number of secrets is read once.
    """
    rows, graded, rest = scan(docs, **columns)
    before = Window.partitionBy("rid").orderBy("start", "kind", "end").rowsBetween(Window.unboundedPreceding, -1)
    done = F.coalesce(F.max("end").over(before), F.lit(0))
    cuts = graded.where(~F.col("copied")).select("rid", F.greatest(done, F.col("end") - F.length("value")).alias("a"), F.col("end").alias("b"), done.alias("done"))
    cuts = cuts.where("b > done").withColumn("piece", F.explode(F.expr(f"sequence(a div {PIECE}, (b - 1) div {PIECE})")))
    base = F.col("piece") * PIECE
    at = F.greatest(F.col("a") - base, F.lit(0)).cast("int")
    cut = F.struct(at.alias("a"), F.least(F.col("b") - base, F.lit(PIECE)).cast("int").alias("b"), (F.col("a") >= base).alias("head"))
    cuts = durable(cuts.groupBy("rid", "piece").agg(F.array_sort(F.collect_list(cut)).alias("cuts")))
    touched = rows.join(cuts.select("rid").distinct(), "rid", "left_semi")
    pieces = touched.select("rid", F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).alias("piece", "p"))

    def step(acc: Column, c: Column) -> Column:
        put = F.concat(acc["out"], F.substring(F.col("p"), acc["at"] + 1, c["a"] - acc["at"]), F.when(c["head"], PLACEHOLDER).otherwise(""))
        return F.struct(put.alias("out"), c["b"].alias("at"))

    clean = F.aggregate(
        "cuts", F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step,
        lambda acc: F.concat(acc["out"], F.substring(F.col("p"), acc["at"] + 1, F.lit(PIECE))))
    pieces = pieces.join(cuts.withColumn("piece", F.col("piece").cast("int")), ["rid", "piece"], "left").select(
        "rid", F.struct("piece", F.coalesce(clean, F.col("p")).alias("p")).alias("p"))
    whole = pieces.groupBy("rid").agg(F.array_join(F.array_sort(F.collect_list("p"))["p"], "").alias("clean"))
    names, body = docs.columns, columns.get("text", "text")
    changed = rows.join(whole, "rid", "left").select(
        *[F.coalesce("clean", f"row.{c}").alias(c) if c == body
          else F.when(F.col("clean").isNull(), F.col(f"row.{c}")).otherwise(F.length("clean").cast(docs.schema[c].dataType)).alias(c)
          if c == "n_chars" else F.col(f"row.{c}") for c in names])
    return changed.unionByName(rest.select("row.*"))


def sql() -> str:
    """DuckDB's way to the same result."""
    def kind(i: int) -> str:
        name, pattern, group, least = KINDS[i]
        quoted = pattern.replace("'", "''")
        return f"""
  SELECT rid, {i} AS kind, '{name}' AS name, CAST(a AS INT) AS a, CAST(a + length(w) AS INT) AS b, v FROM (
    SELECT rid, w, v, sum(length(p)) OVER (PARTITION BY rid ORDER BY k) + sum(length(w)) OVER (PARTITION BY rid ORDER BY k)
           - length(w) AS a FROM (
      SELECT rid, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS w, unnest(v) AS v, unnest(p[1:len(w)]) AS p FROM (
        SELECT rid, regexp_extract_all(t, '{quoted}') AS w, regexp_extract_all(t, '{quoted}', {group}) AS v,
               string_split_regex(t, '{quoted}') AS p FROM d)))
  WHERE length(v) >= {least}"""
    union = "\n  UNION ALL".join(kind(i) for i in range(OPAQUE))
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source AS owner, concat_ws('/', source, lang) AS repo,
  coalesce(text, '') AS t FROM documents),
base AS ({union}),
opaque AS (
  SELECT o.* FROM ({kind(OPAQUE)}) o
  WHERE length(regexp_replace(v, '[^0-9]', '', 'g')) >= 3 AND length(regexp_replace(v, '[^A-Za-z]', '', 'g')) >= 3
    AND NOT EXISTS (SELECT 1 FROM base b WHERE b.rid = o.rid AND b.a < o.b AND o.a < b.b)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM opaque),
freq AS (
  SELECT v, count(DISTINCT coalesce(owner, chr(0))) AS n_owners, count(DISTINCT (coalesce(owner, chr(0)), repo)) AS n_repos
  FROM every JOIN d ON every.rid = d.rid GROUP BY v),
f AS (SELECT *, n_owners >= {COPIED_OWNERS} OR n_repos >= {COPIED_REPOS} AS copied FROM freq),
s AS (SELECT every.*, n_owners, n_repos, copied FROM every JOIN f ON every.v = f.v WHERE kind < {OPAQUE} OR NOT copied),
g AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
         string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) FILTER (kind < {OPAQUE}) AS base,
         string_agg(name || ':' || a || ':' || b, ',' ORDER BY a, kind) AS spans,
         count(*) FILTER (NOT copied) AS n_owned, count(*) FILTER (copied) AS n_copied,
         max(n_owners) AS most_owners, max(n_repos) AS most_repos
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_owned, 0) AS n_owned, coalesce(n_copied, 0) AS n_copied,
       coalesce(most_owners, 0) AS most_owners, coalesce(CAST(most_repos AS BIGINT), 0) AS most_repos
FROM d LEFT JOIN g ON d.rid = g.rid"""
