"""Duplicates, nearest titles, heading clusters and reconciliation.

Keys are computed once a record.  The fuzzy operators are exact over all pairs: records with equal
keys are one class, and only distinct keys are compared.  ``block`` restricts them to pairs that
share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import expr as E
from ..functions import udfs


def _keyed(records: DataFrame) -> DataFrame:
    """file, record_no, title, naco, tkey and matchkey of each record."""
    found = records.select("file", "record_no", F.expr(E.place("fields", "245a")).alias("title"), udfs.call("marc_naco", E.nearest_title("fields")).alias("tkey"), udfs.call("marc_matchkey_of", *E.match_key_parts("fields")).alias("matchkey"))
    return found.withColumn("naco", udfs.call("marc_naco", "title"))


def _sides(left: DataFrame, right: DataFrame, a: str, b: str) -> tuple[DataFrame, DataFrame]:
    return left.select([F.col(c).alias(f"{c}_{a}") for c in left.columns]), right.select([F.col(c).alias(f"{c}_{b}") for c in right.columns])


def _same_key(a: str, b: str) -> Column:
    return F.coalesce(F.col(f"matchkey_{a}") == F.col(f"matchkey_{b}"), F.lit(False))


def _least_ratio(threshold: float) -> float:
    """The least ratio of lengths at which a Jaro-Winkler similarity can reach ``threshold``: at most
    0.4 of what Jaro leaves is added, over 0.7 only, and Jaro is (m/|s| + m/|t| + 1)/3 at most."""
    jaro = threshold if threshold <= 0.7 else max(0.7, (threshold - 0.4) / 0.6)
    return max(0.0, 3 * jaro - 2 - 1e-9)


def _alike(keyed: DataFrame, threshold: float) -> DataFrame:
    """(naco_a, naco_b, similarity) of distinct titles at least ``threshold`` alike, in both orders,
    as Jaro-Winkler need not be symmetric; compared are those whose lengths allow it."""
    keys = keyed.filter("naco IS NOT NULL").select("naco").distinct().withColumn("n", F.octet_length("naco"))
    ratio = min(1.0, _least_ratio(threshold))
    longer = keys.select(F.col("naco").alias("long"), F.explode(F.sequence(F.ceil(F.col("n") * ratio).cast("int"), "n")).alias("n"))
    pairs = longer.join(keys.select(F.col("naco").alias("short"), "n"), "n")
    both = pairs.select(F.col("long").alias("naco_a"), F.col("short").alias("naco_b")).union(pairs.filter("octet_length(short) < octet_length(long)").select("short", "long"))
    return both.withColumn("similarity", udfs.call_once("jaro_winkler_similarity", "naco_a", "naco_b")).filter(F.col("similarity") >= threshold)


#: Numbers that a block of records spans: of a pair's first records and of its second.  Blocks of the
#: first are small, as their pairs are sorted together; those of the second only bound a row.
FIRST, SECOND = 1 << 8, 1 << 16
LISTS = ("record_nos", "titles", "matchkeys")
#: A row of blocks counts as its pairs when ranges are sampled: it has empty copies, which end as outer
#: explodes that find nothing (Spark would drop them before the ranges otherwise).
COPIES = "sequence(0, size(record_nos_a) * size(record_nos_b) div 1024)"


def _blocks(keyed: DataFrame, keys: list[str], width: int, side: str) -> DataFrame:
    """The records of equal ``keys`` and of ``width`` numbers of a file as one row, in their order."""
    own = F.array_sort(F.collect_list(F.struct("record_no", "title", "matchkey"))).alias("own")
    found = keyed.groupBy(*keys, "file", F.expr(f"record_no div {width}").alias("block")).agg(own, F.min("record_no").alias("least"), F.max("record_no").alias("most"))
    parts = [F.expr(f"transform(own, x -> x.{c})").alias(f"{c}s_{side}") for c in ("record_no", "title", "matchkey")]
    return found.select(*[F.col(c).alias(f"{c}_{side}") for c in (*keys, "file", "block", "least", "most")], *parts)


def sorting_tasks(spark: SparkSession) -> int:
    """Tasks that sort pairs: many, so that each can do so in memory."""
    return max(32 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _all_candidates(keyed: DataFrame, threshold: float, *order: str) -> DataFrame:
    """The pairs by ``order`` and by both records.  Not they are joined and shuffled, but blocks of
    records with equal keys; their tasks, which are ranges of that order, make the pairs and sort them."""
    # A match key of one record alone needs no comparing.
    alone = F.count("*").over(Window.partitionBy("matchkey", F.expr("IF(matchkey IS NULL, record_no, NULL)"))) == 1
    keyed = keyed.withColumn("alone", alone).withColumn("matchkey", F.expr("IF(alone, NULL, matchkey)"))
    titled, shared = keyed.filter("naco IS NOT NULL"), keyed.filter("matchkey IS NOT NULL")
    follows = F.expr("file_a < file_b OR (file_a = file_b AND least_a < most_b)")
    ends = [f"{c}_{side}" for side in "ab" for c in ("file", "block", *LISTS)]
    alike = _blocks(titled, ["naco"], FIRST, "a").join(_alike(titled, threshold), "naco_a").join(_blocks(titled, ["naco"], SECOND, "b"), "naco_b").filter(follows)
    same = _blocks(shared, ["matchkey", "naco"], FIRST, "a").join(_blocks(shared, ["matchkey", "naco"], SECOND, "b"), follows & (F.col("matchkey_a") == F.col("matchkey_b")))
    same = same.withColumn("similarity", udfs.call_once("jaro_winkler_similarity", "naco_a", "naco_b"))
    found = alike.select(*ends, "similarity", F.lit(False).alias("same_matchkey")).unionByName(same.select(*ends, "similarity", F.lit(True).alias("same_matchkey")))
    first = [*(f"order_{i}" for i in range(len(order))), "file_a", "block_a"]
    found = found.select("*", F.explode(F.expr(COPIES)).alias("copy")).withColumns({c: F.expr(f"IF(copy = 0, {c}, NULL)") for c in ends if c[:-2] in LISTS})
    dealt = found.withColumns({f"order_{i}": F.expr(e) for i, e in enumerate(order)}).repartitionByRange(sorting_tasks(keyed.sparkSession), *first)
    each = dealt.select("*", F.posexplode_outer("record_nos_a").alias("i", "record_no_a")).select("*", F.posexplode_outer("record_nos_b").alias("j", "record_no_b"))
    ordered = F.expr("file_a < file_b OR (file_a = file_b AND record_no_a < record_no_b)")
    pairs = each.filter("i IS NOT NULL AND j IS NOT NULL").filter(ordered).filter("same_matchkey OR NOT coalesce(get(matchkeys_a, i) = get(matchkeys_b, j), false)")
    pairs = pairs.select(*first, "record_no_a", "file_b", "record_no_b", F.expr("get(titles_a, i)").alias("title_a"), F.expr("get(titles_b, j)").alias("title_b"), "similarity", "same_matchkey")
    return pairs.orderBy(*first, "record_no_a", "file_b", "record_no_b").select(*_CANDIDATE)


_CANDIDATE = ["file_a", "record_no_a", "file_b", "record_no_b", "title_a", "title_b", "similarity", "same_matchkey"]
#: The order of the fuzzy report before that of its records: equal match keys, then the most alike.
FUZZY_ORDER = ("NOT same_matchkey", "coalesce(-similarity, 1)")


def dedupe_candidates(records: DataFrame, threshold: float, block: str | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Unordered pairs whose titles are at least ``threshold`` alike or whose match keys are equal, by
    ``order`` (SQL expressions over similarity and same_matchkey) and by their records.
    ``block`` is an SQL expression over naco, tkey and matchkey that candidates must share."""
    keyed = _keyed(records)
    if not block:
        return _all_candidates(keyed, threshold, *order)
    keyed = keyed.withColumn("block", F.expr(block))
    a, b = _sides(keyed, keyed, "a", "b")
    ordered = (F.col("file_a") < F.col("file_b")) | ((F.col("file_a") == F.col("file_b")) & (F.col("record_no_a") < F.col("record_no_b")))
    pairs = a.join(b, ordered & (F.col("block_a") == F.col("block_b")))
    scored = pairs.withColumn("similarity", udfs.call_once("jaro_winkler_similarity", "naco_a", "naco_b")).withColumn("same_matchkey", _same_key("a", "b"))
    kept = scored.filter((F.col("similarity") >= threshold) | F.col("same_matchkey"))
    return kept.select(*_CANDIDATE).orderBy(*map(F.expr, order), "file_a", "record_no_a", "file_b", "record_no_b")


def _nearest(queries: DataFrame, targets: DataFrame, a: str, b: str, k: int, drop_self: bool, least: float, block: str | None) -> DataFrame:
    if block:
        queries, targets = (x.withColumn("block", F.expr(block)) for x in (queries, targets))
    q, t = _sides(queries, targets, a, b)
    of_record = Window.partitionBy(f"file_{a}", f"record_no_{a}")
    if not block:
        # Equal keys are equally near, so of each target key the first k records are enough, and
        # they are ranked once for each query key.
        first = F.row_number().over(Window.partitionBy(f"tkey_{b}").orderBy(f"file_{b}", f"record_no_{b}"))
        t = t.filter(f"tkey_{b} IS NOT NULL").withColumn("first", first).filter(F.col("first") <= k).drop("first")
        keys = q.filter(f"tkey_{a} IS NOT NULL").select(f"tkey_{a}").distinct().crossJoin(t.select(f"tkey_{b}").distinct())
        near = keys.withColumn("similarity", udfs.call_once("jaro_winkler_similarity", f"tkey_{a}", f"tkey_{b}")).filter("similarity IS NOT NULL")
        nearest_keys = F.row_number().over(Window.partitionBy(f"tkey_{a}").orderBy(F.desc("similarity"), f"file_{b}", f"record_no_{b}"))
        # A key is among the k nearest only if fewer than k keys are nearer.
        level = F.rank().over(Window.partitionBy(f"tkey_{a}").orderBy(F.desc("similarity")))
        near = near.withColumn("level", level).filter(F.col("level") <= k).drop("level").join(t, f"tkey_{b}")
        scored = q.join(near.withColumn("nearest", nearest_keys).filter(F.col("nearest") <= k).drop("nearest"), f"tkey_{a}")
    else:
        pairs = q.join(t, F.col(f"block_{a}") == F.col(f"block_{b}"))
        scored = pairs.withColumn("similarity", udfs.call_once("jaro_winkler_similarity", f"tkey_{a}", f"tkey_{b}")).filter("similarity IS NOT NULL")
    # Ranked before anything is dropped: the record itself counts among its nearest.
    rank = F.row_number().over(of_record.orderBy(F.desc("similarity"), f"file_{b}", f"record_no_{b}"))
    best = scored.withColumn("rank", rank).filter(F.col("rank") <= k).withColumn("same_matchkey", _same_key(a, b))
    if drop_self:
        best = best.filter((F.col(f"file_{a}") != F.col(f"file_{b}")) | (F.col(f"record_no_{a}") != F.col(f"record_no_{b}")))
    best = best.filter((F.col("similarity") >= least) | F.col("same_matchkey"))
    names = [f"{c}_{s}" for s in (a, b) for c in ("file", "record_no", "title")]
    return best.select(*names, "similarity", "same_matchkey").orderBy(f"file_{a}", f"record_no_{a}", F.desc("similarity"), f"file_{b}", f"record_no_{b}")


def nearest_dupes(records: DataFrame, min_similarity: float = 0.0, block: str | None = None) -> DataFrame:
    """For each record its nearest others (five, or six less itself) by title."""
    keyed = _keyed(records)
    return _nearest(keyed, keyed, "a", "b", 6, True, min_similarity, block)


def nearest_matches(queries: DataFrame, targets: DataFrame, min_similarity: float = 0.0, k: int = 5, block: str | None = None, how: str = "inner") -> DataFrame:
    """For each query record its ``k`` nearest target records by title.  ``how="left"`` keeps query
    records without a match, their target columns null; ``how="anti"`` gives only those, in three
    columns."""
    if int(k) != k or k < 1:
        raise ValueError("k must be a positive integer")
    if how not in ("inner", "left", "anti"):
        raise ValueError("how must be inner, left or anti")
    keyed = _keyed(queries)
    found = _nearest(keyed, _keyed(targets), "q", "t", int(k), False, min_similarity, block)
    if how == "inner":
        return found
    own = [f"{c}_q" for c in ("file", "record_no")]
    rest = keyed.select(*[F.col(c).alias(f"{c}_q") for c in ("file", "record_no", "title")]).join(found.select(*own).distinct(), own, "left_anti")
    return rest if how == "anti" else found.unionByName(rest, allowMissingColumns=True)


def each_heading(records: DataFrame) -> DataFrame:
    return records.select(F.explode(F.expr(E.headings("fields"))).alias("heading"))


def nearest_headings(records: DataFrame, labels: DataFrame, min_similarity: float = 0.0) -> DataFrame:
    """For each distinct heading the three nearest of ``labels`` (column label)."""
    found = each_heading(records).groupBy("heading").agg(F.count("*").alias("n_occurrences")).withColumn("hkey", udfs.call("marc_naco", "heading"))
    scored = found.crossJoin(labels.select("label", udfs.call("marc_naco", "label").alias("lkey"))).withColumn("similarity", udfs.call_once("jaro_winkler_similarity", "hkey", "lkey")).filter("similarity IS NOT NULL")
    rank = F.row_number().over(Window.partitionBy("heading").orderBy(F.desc("similarity"), "label"))
    best = scored.withColumn("rank", rank).filter((F.col("rank") <= 3) & (F.col("similarity") >= min_similarity))
    return best.select("heading", "n_occurrences", "label", "similarity").orderBy(F.desc("n_occurrences"), "heading", F.desc("similarity"), "label")


def cluster_headings(records: DataFrame, method: str = "fingerprint") -> DataFrame:
    """Headings that share a key, with their variants."""
    keys = {"fingerprint": lambda: udfs.call_once("marc_fingerprint", "heading"), "ngram": lambda: udfs.call_once("marc_ngram_fingerprint", F.col("heading"), F.lit(2))}
    if method not in keys:
        raise ValueError("method must be fingerprint or ngram")
    # Distinct headings first: a frequent heading is normalised once and moves as one row.
    found = each_heading(records).groupBy("heading").agg(F.count("*").alias("n")).withColumn("key", keys[method]()).filter("key != ''")
    grouped = found.groupBy("key").agg(F.sum("n").alias("n_headings"), F.count("*").alias("n_variants"), F.array_sort(F.collect_list("heading")).alias("members"))
    return grouped.orderBy(F.desc("n_variants"), F.desc("n_headings"), "key")


def reconcile_headings(records: DataFrame, base: str) -> DataFrame:
    """Distinct headings with counts and the address to look them up at; ``base`` is idloc, viaf,
    wikidata or an address that the escaped heading is appended to."""
    urls = {"idloc": E.idloc_suggest_url, "viaf": E.viaf_search_url, "wikidata": E.wikidata_search_url}
    url = urls[base]("heading") if base in urls else f"concat({E.q(base)}, {E.url_encode('heading')})"
    return each_heading(records).groupBy("heading").agg(F.count("*").alias("n_occurrences")).withColumn("url", F.expr(url)).orderBy(F.desc("n_occurrences"), "heading")


def authority_flips(records: DataFrame, authorities: DataFrame) -> DataFrame:
    """(file, record_no, heading, authorized): headings that an authority record refers from, by an
    equi-join on NACO forms instead of a product of the two."""
    refs = authorities.select(F.monotonically_increasing_id().alias("a"), udfs.call("marc_authority_refs", "leader", "fields").alias("refs"))
    refs = refs.withColumn("authorized", F.expr("get(filter(refs, r -> r.kind = 'authorized'), 0).heading"))
    variants = refs.select("authorized", F.explode(F.expr("filter(refs, r -> r.kind = 'see_from')")).alias("r")).select("authorized", udfs.call("marc_naco", "r.heading").alias("key"))
    used = records.select("file", "record_no", F.posexplode(F.expr(E.headings("fields"))).alias("heading_no", "heading")).withColumn("key", udfs.call("marc_naco", "heading"))
    return used.join(variants.filter("key IS NOT NULL"), "key").select("file", "record_no", "heading_no", "heading", "authorized").distinct()
