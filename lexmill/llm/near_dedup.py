"""MinHash near-dedup by an LSH forest: link documents whose 5-word shingle sets have a similarity of 0.75 or more.

1. Sketch: whole texts become shingle sets, least values of 192 hash functions and, for each of 24 trees, a sort key
   of eight of them. Texts with equal sets are one class, told apart by size and 128-bit digest.
2. Forest: in each tree, classes stand in the order of their keys. A region is a stretch whose keys agree on the first
   four values; a pair of similarity 0.75 shares a region of some tree with a chance of 0.9999. Neighbours in a
   region, ``PLACES`` apart at most, are candidates. A region of up to ``PLACES`` + 1 classes so gives all its pairs. In a
   crowded one, the order goes on as deep as keys differ, so neighbours are those of the longest common prefixes, and
   its classes go to step 4 as well.
3. Candidates whose sketches agree by less than 0.62 (over four standard errors below) or whose sizes can't reach the
   similarity leave. Full sets confirm each class's three best candidates, then the others that join two components.
4. Crowd: the exact way for pairs that the places of a crowded region leave out. Of the classes in crowded regions, two
   of different components that are similar enough have a common shingle among their rarest ones, counted over these
   classes: those that stand before the last 3/7 of both sizes together. Shingles that one component alone has come
   first and never meet, so texts that share a template or a passage, yet are not similar enough, form no pair while
   their own parts are long enough to keep them apart. Postings (shingle, sizes within four percent) of several
   components form pairs: first with the posting's two hubs, until that joins few, then, in blocks, all that are left.

Hot groups: exact copies are one class from the first aggregation on. The order of a tree is cut into ranges anywhere,
also within a region, and neighbours across the cuts are candidates like others. A large group of near copies is joined
by its best candidates and hubs, and then has no shingle of several components; postings of over ``BLOCK`` rows are cut
into blocks. What is left quadratic is a crowd whose own parts are under a seventh of the texts, yet not similar enough.

Cases: a text without words has no shingles, is linked with nothing and is its own component; a null id has a null
component; rows of one id count as one document, so an id with several texts links them; an empty table gives no rows;
texts of any length are read whole; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.arrays import Powers, give_back
from lexmill.llm.components import components
from lexmill.llm.sketches import SKETCH, TREES, agreement, digest, shingle_sets, sketch_batch
from lexmill.session import save, ship_package, table

#: Rows in order whose neighbours are formed at once; the last ones are carried on to the next.
REGION = 1 << 16
PLACES = 2
BEST = 3
LEAST_AGREEMENT = 0.62
#: Set sizes within this ratio share their prefixes' length.
SIZES = 1.04
#: Rows of a posting that one block pairs with each other.
BLOCK = 1024
#: Hubs go on while a round of them joins at least this share of the crowd's components.
HUB_SHARE = 0.25
#: Ids that are picked out of the documents are broadcast up to this many; more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    powers = Powers()
    for batch in batches:
        yield sketch_batch(batch, powers)
        del batch
        give_back()


def _shingles(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Size, digest and members of each text's set."""
    powers = Powers()
    for batch in batches:
        sets = list(shingle_sets(batch, powers))
        digests = np.array([digest(s) for s in sets], np.uint64).reshape(-1, 2).view(np.int64)
        n = np.array([len(s) for s in sets], np.int64)
        members = pa.array(np.concatenate(sets + [np.zeros(0, np.uint64)]).view(np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), members)
        yield pa.StructArray.from_arrays([pa.array(n), pa.array(digests[:, 0]), pa.array(digests[:, 1]), lists], ["n", "d1", "d2", "set"])
        del batch, sets, members, lists
        give_back()


def _agreement(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array(agreement(a, b))


_EDGES = ["rep", "tree", "high", "low", "tie"]


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs (rep, p) of rows of a region within ``PLACES`` of each other in a range of the order, rows of crowded
    regions paired with themselves, and the range's first and last rows, without p."""
    none = np.zeros((5, 0), np.int64)
    last, n, most = none, 0, PLACES + 1

    def edges(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.nulls(rows.shape[1], pa.int64()), *map(pa.array, rows[1:])], ["rep", "p", *_EDGES[1:]])

    for batch in batches:
        every = np.stack([batch.column(k).to_numpy() for k in range(5)]) if batch.num_rows else none
        for at in range(0, every.shape[1], REGION):
            own = every[:, at : at + REGION]
            if n < most:
                yield edges(own[:, : most - n])
            n += own.shape[1]
            rows = np.concatenate([last, own], 1)
            found = []
            for k in range(1, most + 1):
                x, y = rows[:, k:], rows[:, :-k]
                same = (x[1] == y[1]) & (x[2] == y[2])
                if k == most:  # a region of more rows than places reach
                    crowd = np.unique((np.flatnonzero(same)[:, None] + np.arange(most + 1)).ravel())
                    found.append((rows[0][crowd], rows[0][crowd]))
                    break
                same[: max(0, last.shape[1] - k)] = False  # formed before
                found.append((x[0][same], y[0][same]))
            rep, p = (np.concatenate(f) for f in zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(p), *[pa.nulls(len(rep), pa.int64())] * 4], ["rep", "p", *_EDGES[1:]])
            last = rows[:, -most:]
    if n > most:
        yield edges(last[:, -(n - most) :])


def _across(edges: DataFrame) -> DataFrame:
    """The pairs (rep, p) of ``_neighbours`` over the cuts between ranges, from the ranges' first and last rows."""
    order = Window.partitionBy("tree", "high").orderBy("low", "tie", "rep")
    lags = [F.lag("rep", k).over(order) for k in range(1, PLACES + 2)]
    rows = edges.select("rep", F.array(*lags[:PLACES]).alias("ps"), lags[PLACES].alias("far"), *[x.alias(f"l{k}") for k, x in enumerate(lags[:PLACES])])
    near = rows.select("rep", F.explode("ps").alias("p"))
    crowd = rows.filter("far is not null").select(F.explode(F.array("rep", "far", *[f"l{k}" for k in range(PLACES)])).alias("rep"))
    return near.filter("p is not null").unionByName(crowd.withColumn("p", F.col("rep")))


def candidates(classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b, agreement) of classes that are neighbours in some tree and pass the sketch filter, and (rep) of crowded regions."""
    ship_package(classes.sparkSession)
    trees = F.sequence(F.lit(1).cast("long"), F.lit(TREES).cast("long")).alias("tree")
    keys = classes.select("rep", F.explode(F.arrays_zip(trees, "high", "low")).alias("k")).select("rep", "k.tree", "k.high", "k.low").withColumn("tie", F.xxhash64("rep", "tree"))
    order = ["tree", "high", "low", "tie", "rep"]
    near = save(keys.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "rep long, p long, tree long, high long, low long, tie long"), "neighbours")
    found = near.filter("p is not null").select("rep", "p").unionByName(_across(near.filter("p is null")))
    found = save(found.select(F.least("rep", "p").alias("a"), F.greatest("rep", "p").alias("b")).distinct(), "pairs")
    return sketch_filter(found.filter("a <> b"), classes), found.filter("a = b").select(F.col("a").alias("rep"))


def sketch_filter(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b, agreement) of the distinct pairs whose sizes and sketches leave the similarity possible."""
    side = lambda x: classes.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"m_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter("100 * least(n_a, n_b) >= 75 * greatest(n_a, n_b)")
    return both.select("a", "b", F.arrow_udf(_agreement, "double")("m_a", "m_b").alias("agreement")).filter(F.col("agreement") >= LEAST_AGREEMENT).groupBy("a", "b").agg(F.max("agreement").alias("agreement"))


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    side = lambda x: sets.select(F.col("rep").alias(x), F.col("set").alias(f"s_{x}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("s_a", "s_b")).cast("long").alias("shared"), F.size("s_a").cast("long").alias("n_a"), F.size("s_b").cast("long").alias("n_b"))
    return counted.filter("100 * shared >= 75 * (n_a + n_b - shared)").select("a", "b")


def apart(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``pairs`` of different components, with these as x and y."""
    x, y = labels.select(F.col("rep").alias("a"), F.col("label").alias("x")), labels.select(F.col("rep").alias("b"), F.col("label").alias("y"))
    return pairs.join(x, "a").join(y, "b").filter("x <> y")


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """(rep, label) after links (a, b) between classes of ``labels``."""
    more = components(apart(links, labels).select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.col("v").alias("label"), F.col("label").alias("whole"))
    return save(labels.join(more, "label", "left").select("rep", F.coalesce("whole", "label").alias("label")), "labels")


def _bucket(n: Column) -> Column:
    return F.floor(F.log(n.cast("double")) / math.log(SIZES)).cast("int")


def postings(sets: DataFrame, labels: DataFrame) -> DataFrame:
    """(token, p, q, side, rep, label, n, place): rare shingles of each class for partners of each size that can be similar.

    ``sets``: rep, n, set. Shingles stand in order of their counts, those of one component alone first; the place is a
    shingle's number in it. p and q number the sizes of a pair; ``side`` is the class's own.
    """
    rows = sets.join(labels, "rep")
    tokens = rows.select("rep", "label", F.explode("set").alias("token"))
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("c"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi")
    shared = save(counts.select("token", "c"), "shingles")
    common = tokens.join(shared, "token").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("c", "token"))).alias("common"))
    own = rows.select("rep", "label", "n").join(common, "rep").withColumn("alone", F.col("n") - F.size("common"))
    n, side = F.col("n"), _bucket(F.col("n"))
    least = F.ceil(n * 0.75)
    other = F.explode(F.sequence(_bucket(least), _bucket(F.floor(n / 0.75)))).alias("other")
    own = own.select("*", side.alias("side"), other)
    smallest = F.greatest(least, F.ceil(F.pow(F.lit(SIZES), F.col("other")) - 1e-6))
    prefix = n - F.ceil((n + smallest) * 3 / 7) + 1 - F.col("alone")
    own = own.withColumn("prefix", prefix.cast("int")).filter("prefix > 0")
    listed = own.select("rep", "label", "n", "alone", "side", "other", F.posexplode(F.expr("slice(common, 1, prefix)")).alias("k", "t"))
    return listed.select(F.col("t.token").alias("token"), F.least("side", "other").alias("p"), F.greatest("side", "other").alias("q"), "side", "rep", "label", "n", (F.col("alone") + F.col("k")).alias("place"))


_KEY = ["token", "p", "q"]
#: The overlap that the similarity asks for is still possible where this is the pair's first common shingle.
_REACH = "7 * least(n - place, n_2 - place_2) >= 3 * (n + n_2)"


def _with_pairs(posted: DataFrame, *more: Column) -> DataFrame:
    """The postings that have several components, and rows of both sizes."""
    both = [F.min("label").alias("lo"), F.max("label").alias("hi"), F.bool_or(F.expr("side = p")).alias("has_p"), F.bool_or(F.expr("side = q")).alias("has_q")]
    return posted.groupBy(*_KEY).agg(*more, *both).filter("lo <> hi and has_p and has_q")


def hub_pairs(posted: DataFrame) -> DataFrame:
    """(a, b): each row of a posting with the posting's two hubs, of other components."""
    me = F.struct(F.xxhash64("rep").alias("h"), "rep", "label", "side", "n", "place")
    hubs = _with_pairs(posted, F.array(F.min(me), F.max(me)).alias("hubs"))
    hubs = hubs.select(*_KEY, F.explode("hubs").alias("h")).select(*_KEY, *[F.col(f"h.{x}").alias(f"{x}_2") for x in ("rep", "label", "side", "n", "place")])
    pairs = posted.join(hubs, _KEY).filter("label <> label_2 and (p = q or side <> side_2)").filter(_REACH)
    return pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()


def posting_pairs(posted: DataFrame) -> DataFrame:
    """(a, b): all rows of a posting with all others of other components, in blocks."""
    sizes = _with_pairs(posted, F.count(F.lit(1)).alias("size"))
    rows = posted.join(sizes.select(*_KEY, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), _KEY)
    left = rows.filter("side = p").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    right = rows.filter("side = q").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    right = right.select(*_KEY, "block", *[F.col(x).alias(f"{x}_2") for x in ("rep", "label", "n", "place")])
    pairs = left.join(right, [*_KEY, "block"]).filter("label <> label_2 and (p < q or rep < rep_2)").filter(_REACH)
    return pairs.select(F.least("rep", "rep_2").alias("a"), F.greatest("rep", "rep_2").alias("b")).distinct()


def join_crowd(sets: DataFrame, crowd: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """``labels`` after all links between classes of crowded regions."""
    own = save(sets.join(crowd, "rep", "left_semi").select("rep", F.size("set").cast("long").alias("n"), "set"), "crowd")
    own_labels = lambda: labels.join(crowd, "rep", "left_semi")
    parts = own_labels().select("label").distinct().count()
    hubs = True
    while parts > 1:
        posted = save(postings(own, own_labels()), "postings")
        pairs = hub_pairs(posted) if hubs else posting_pairs(posted)
        labels = joined(labels, save(confirm(sketch_filter(pairs, classes), sets), "links"))
        if not hubs:
            break
        left = own_labels().select("label").distinct().count()
        hubs, parts = parts - left >= HUB_SHARE * parts, left
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, n_shingles, component) per row of ``docs``: set size, and the least id that links reach."""
    spark = docs.sparkSession
    ship_package(spark)
    rep = F.xxhash64("n", "d1", "d2")
    sketches = save(docs.select(F.col(id_col).cast("long").alias("doc"), F.arrow_udf(_sketch, SKETCH)(text_col).alias("s")).select("doc", "s.*"), "sketches")
    known = sketches.filter("n > 0 and doc is not null")
    first = known.groupBy("n", "d1", "d2").agg(F.min(F.struct("doc", "marks", "high", "low")).alias("m"), F.count(F.lit(1)).alias("copies"))
    classes = save(first.select("n", "d1", "d2", rep.alias("rep"), "copies", "m.doc", "m.marks", "m.high", "m.low"), "classes")
    pairs, crowd = candidates(classes)
    pairs = save(pairs, "candidates")
    # an id with several texts
    several = known.select("doc", rep.alias("rep")).groupBy("doc").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a <> z").select("doc", "a")
    same_id = save(known.select("doc", rep.alias("b")).join(several, "doc").filter("a <> b").select("a", "b").distinct(), "same-id")
    ends = lambda e: e.select(F.explode(F.array("a", "b")).alias("rep"))
    # a crowded class that has no candidate may still have a partner that the places left out
    needed = save(ends(pairs).unionByName(ends(same_id)).unionByName(crowd).distinct(), "needed")
    wanted = classes.join(needed, "rep", "left_semi").select("doc").distinct()
    if needed.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    own = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).join(wanted, "doc", "left_semi")
    sets = own.select(F.arrow_udf(_shingles, "struct<n:bigint,d1:bigint,d2:bigint,set:array<bigint>>")("text").alias("s")).select("s.*").filter("n > 0")
    sets = save(sets.select(rep.alias("rep"), "set").dropDuplicates(["rep"]), "sets")
    best = Window.partitionBy("u").orderBy(F.desc("agreement"), "a", "b")
    turns = pairs.select("a", "b", "agreement", F.explode(F.array("a", "b")).alias("u"))
    chosen = turns.withColumn("k", F.row_number().over(best)).filter(F.col("k") <= BEST).select("a", "b").distinct()
    labels = joined(needed.withColumn("label", F.col("rep")), save(confirm(chosen, sets).unionByName(same_id), "links"))
    # of the other candidates, those within the crowd are among its pairs
    marked = crowd.select(F.col("rep").alias("a"), F.lit(True).alias("in_a")), crowd.select(F.col("rep").alias("b"), F.lit(True).alias("in_b"))
    others = apart(pairs, labels).join(marked[0], "a", "left").join(marked[1], "b", "left").filter("in_a is null or in_b is null")
    labels = joined(labels, save(confirm(others, sets), "links"))
    labels = join_crowd(sets, crowd, labels, classes)
    component = labels.join(classes.select("rep", "doc"), "rep").groupBy("label").agg(F.min("doc").alias("component"))
    final = labels.join(component, "label").select("rep", "component")
    whole = classes.join(final, "rep", "left").filter("copies > 1 or component < doc")
    whole = save(whole.select("n", "d1", "d2", F.coalesce("component", "doc").alias("component")), "components")
    found = sketches.select("doc", "n", "d1", "d2").join(whole, ["n", "d1", "d2"], "left")
    return found.select("doc", F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component"))


def op5_near_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("doc") == F.col("component"), F.lit(False)).alias("kept"))


OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 75 * (nx.n + ny.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS v, doc_id AS u FROM documents UNION SELECT r.v, e.y FROM r JOIN e ON e.x = r.u),
m AS (SELECT v, min(u) AS c FROM r GROUP BY 1)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c AS component_id, doc_id = c AS kept FROM documents JOIN m ON v = doc_id LEFT JOIN n USING (doc_id)
"""
