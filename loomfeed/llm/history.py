"""Hold new batches against all accepted history: whole copies and near-copies.

Each record becomes a few 64-bit hashes of its normalised contents: the page
its URL leads to, its id within its source, its headline. A headline also
counts as a short text of three parts: edits in two places leave at least one
part whole, so near-copies share a part hash, and sharing is verified by edit
distance. A stored headline has one hash per part; a new one asks with a few
more, for the lengths and places that an edit may have moved a part to.

The history is three bucketed tables: keys of whole contents, parts, and
labels (the item of each repeated record). A batch is joined to them bucket by
bucket, without moving a row of history, and its new hashes are appended; keys
that history has already aren't stored again.

A part that many headlines share is split: its headlines are told apart by the
parts of what is left of them, again and again, so the search stays exact
without comparing all that share a part. The hashes of a split part are
written once, by the batch that made it crowded.

Links are contracted to components by alternating stars, over the items that
they touch and not over all history: the ends of new links are replaced by
their items' labels first, so a batch that connects two items merges them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE, fold, strip
from ..functions.urls import page_key
from ..operators.timestamps import source_key
from ..runtime import Bucketed, checkpoint, join_hot, scratch, shuffle_width

# Words that editors put before or after a headline.
BEFORE = "update|updated|correction|corrected|icymi|repost|breaking|exclusive|korrektur|aktualisiert|mise à jour|correctif|actualización|corrección"
#: Letters that may be added or left out in one place, such as a short word.
EDITS = 3
#: Letters (and digits) from which a headline may differ by an edit, and from which by two.
ONE_EDIT, TWO_EDITS = 12, 32
#: Headlines per part beyond which the part is split.
CROWDED = 64
#: Lengths of parts are multiples of this.
GRID = 4
#: Batches of the one-table query are held against history in so many groups (each costs some sixty small jobs).
ROUNDS = 2

KEYS = ["page", "external", "headline"]


def plain_title(title: Column, site: Column) -> Column:
    """A headline without entities, editors' marks and the site's own name."""
    t = F.regexp_replace(title, f"{SPACE}+", " ")
    for entity, char in (("&quot;", '"'), ("&#0?39;|&apos;|&rsquo;", "'"), ("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        t = F.regexp_replace(t, entity, char)
    t = F.regexp_replace(F.trim(t), " & ", " and ")
    t = F.regexp_replace(t, f"^(?i)(?:[\\[(](?:{BEFORE})[\\])]|(?:{BEFORE}) ?[:–—-]) *", "")
    t = F.regexp_replace(t, f" *(?i)(?:[\\[(](?:{BEFORE})[\\])])$", "")
    name = F.lower(strip(site))
    ends = (F.length(name) > 2) & F.lower(t).endswith(name)
    return F.transform(F.array(F.struct(t.alias("t"), name.alias("n"), ends.alias("e"))), lambda x: F.when(
        x["e"] & F.substring(x["t"], F.lit(1), F.length(x["t"]) - F.length(x["n"])).rlike("[|–—·:-] *$"),
        F.regexp_replace(F.substring(x["t"], F.lit(1), F.length(x["t"]) - F.length(x["n"])), "[ |–—·:-]+$", ""),
    ).otherwise(x["t"]))[0]


def title_forms(articles: DataFrame) -> DataFrame:
    """Append ``_t`` (letters and digits of the headline, null if it names no item) and ``_nums`` (its numbers, in order).

    A headline names an item if it has five words, or three and a number.
    Fewer are the names of columns that recur by habit.
    """
    df = articles.withColumn("_plain", plain_title(F.col("title"), F.col("source_name")))
    words = F.size(F.filter(F.split("_plain", "[^\\p{L}\\p{N}'’.]+"), lambda w: w != ""))
    named = (words >= 5) | ((words >= 3) & F.col("_plain").rlike("\\p{N}"))
    return df.withColumns({
        "_t": F.when(named, F.regexp_replace(fold(F.col("_plain")), "[^\\p{L}\\p{N}]+", "")),
        "_nums": F.array_join(F.regexp_extract_all(F.col("_plain"), F.lit("(\\p{N}+)"), 1), "."),
    }).drop("_plain")


def keyed(articles: DataFrame) -> DataFrame:
    """``id, page, external, headline`` (hashes or null), ``_t`` and ``_nums`` of each record with an id."""
    source = source_key(F.col("source_id"))
    external = strip(F.col("external_id"))
    return title_forms(articles.where("article_id IS NOT NULL")).select(
        F.col("article_id").alias("id"),
        F.when(page_key(F.col("url")).isNotNull(), F.xxhash64(F.lit("page"), page_key(F.col("url")))).alias("page"),
        F.when((external != "") & source.isNotNull(), F.xxhash64(F.lit("external"), source, external)).alias("external"),
        F.when(F.col("_t") != "", F.xxhash64(F.lit("headline"), "_t", "_nums")).alias("headline"),
        "_t",
        "_nums",
    )


def _one_place(x: Column, y: Column) -> Column:
    """Whether the longer of two texts is the other with up to ``EDITS`` letters more in one place."""
    short, long = F.when(F.length(x) < F.length(y), x).otherwise(y), F.when(F.length(x) < F.length(y), y).otherwise(x)
    more = F.length(long) - F.length(short)
    whole = lambda p: F.concat(F.substring(long, F.lit(1), p), F.substring(long, p + more + 1, F.length(long))) == short
    return (more > 0) & (more <= EDITS) & F.exists(F.sequence(F.lit(0), F.length(short)), whole)


def is_near(x: Column, y: Column) -> Column:
    """Whether two headlines (letters and digits) differ by small edits only.

    One letter changed, added or left out, or two neighbours swapped; in long
    headlines two such edits; or up to ``EDITS`` letters more in one place,
    such as a short word. Very short headlines are the same or they aren't.
    """
    n = F.least(F.length(x), F.length(y))
    d = F.levenshtein(x, y, EDITS)
    swapped = (d == 2) & (F.array_sort(F.split(x, "")) == F.array_sort(F.split(y, "")))
    small = (d <= 1) | ((n >= TWO_EDITS) & (d == 2)) | swapped | ((d == F.abs(F.length(x) - F.length(y))) & _one_place(x, y))
    return (d == 0) | ((n >= ONE_EDIT) & (d > 0) & small)


#: A part of a text: its name, where it begins, its length, and whether there is one.
Cut = tuple[str, Column, Column, Column]


def _stored(r: Column) -> list[Cut]:
    """The three parts of a text. Their length is a third of it, to a grid."""
    n = F.length(r)
    size = (F.floor(n / (3 * GRID)) * GRID).cast("int")
    return [("front", F.lit(0), size, size > 0), ("middle", size, size, size > 0), ("back", n - size, size, size > 0)]


def _asked(r: Column) -> list[Cut]:
    """The parts that near-copies of a text may have in its place.

    Near-copies are up to ``EDITS`` letters longer or shorter, so their parts
    may be one step of the grid longer or shorter. The front stays at the
    front and the back at the back; the middle is asked for only if both have
    an edit, and one edit before it moves it by one letter.
    """
    n = F.length(r)
    size = (F.floor(n / (3 * GRID)) * GRID).cast("int")
    beyond = n % (3 * GRID)
    other = F.when(beyond < EDITS, size - GRID).when(beyond >= 3 * GRID - EDITS, size + GRID).otherwise(0)
    out = []
    for s in (size, other):
        out += [("front", F.lit(0), s, s > 0), ("back", n - s, s, s > 0), *(("middle", s + move, s, s > 0) for move in (-1, 0, 1))]
    return out


def _key(k: Column, r: Column, cut: Cut) -> Column:
    name, at, size, _ = cut
    return F.xxhash64(k, F.lit(name), size, F.substring(r, at + 1, size))


def _keys(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """``k, id`` of the parts of each row's ``r``; ``k`` names the parts so far."""
    each = F.array(*(F.when(cut[3], _key(F.col("k"), F.col("r"), cut)) for cut in cuts))
    return rows.select("id", F.explode(each).alias("k")).where("k IS NOT NULL").select("k", "id")


def _expand(rows: DataFrame, cuts: list[Cut]) -> DataFrame:
    """Each row once for each of the parts of its ``r``, with what is left without the part as ``r``."""
    left = lambda at, size: F.concat(F.substring("r", F.lit(1), at), F.substring("r", at + size + 1, F.length("r")))
    each = F.array(*(F.when(cut[3], F.struct(_key(F.col("k"), F.col("r"), cut).alias("k"), left(cut[1], cut[2]).alias("r"))) for cut in cuts))
    return rows.withColumn("_e", F.explode(each)).where("_e IS NOT NULL").withColumns({"k": F.col("_e.k"), "r": F.col("_e.r")}).drop("_e")


def _variants(rows: DataFrame) -> DataFrame:
    """Each row once for its short ``r``, and for all that is left of it without one, two and so on up to ``EDITS`` letters; nothing is left as ``r``."""
    less = lambda texts: F.array_distinct(F.flatten(F.transform(texts, lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t)))))))
    steps = [F.array("r")]
    for _ in range(EDITS):
        steps.append(less(steps[-1]))
    made = rows.withColumn("_e", F.explode(F.array_distinct(F.flatten(F.array(*steps)))))
    return made.withColumns({"k": F.xxhash64("k", F.lit("rest"), "_e"), "r": F.lit("")}).drop("_e")


def _split(rows: DataFrame, cuts: list[Cut], slack: int = 0) -> DataFrame:
    """``_expand`` by parts, or by variants where too little is left for parts; who asks (with ``slack``) asks for what a text of another length has, too."""
    n, least = F.length("r"), 3 * GRID
    by_parts, by_variants = rows.where(n >= least - slack), rows.where((n > 0) & (n < least + slack))
    return _expand(by_parts, cuts).unionByName(_variants(by_variants))


class History:
    """The stored keys, parts and labels of all accepted records, below one path."""

    WHOLE, PARTS, LABELS = "k long, id long", "k long, id long, t string, nums string, r string", "id long, first long"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        """``buckets`` must be the same each time a path is used (the shuffle partitions of the session if none are given)."""
        n = buckets or shuffle_width(spark)
        self.spark = spark
        self.whole = Bucketed(spark, f"{path}/whole", ["k"], n)
        self.parts = Bucketed(spark, f"{path}/parts", ["k"], n)
        self.labels = Bucketed(spark, f"{path}/labels", ["id"], n)

    def reopen(self) -> History:
        """Register tables that an earlier session wrote."""
        for table, schema in ((self.whole, self.WHOLE), (self.parts, self.PARTS), (self.labels, self.LABELS)):
            table.open(schema)
        return self

    def drop(self) -> None:
        for table in (self.whole, self.parts, self.labels):
            table.drop()


def _whole_links(keys: DataFrame, history: History) -> tuple[DataFrame, DataFrame]:
    """Links ``a, b`` by whole contents, and ``k, id, t, nums`` of the keys that history doesn't have (texts for headlines only)."""
    each = [F.struct(F.col(c).alias("k"), (F.col(f"_{c}") if c.startswith("t") else F.lit(None).cast("string")).alias("t")) for c in KEYS[:2]]
    each.append(F.struct(F.col("headline").alias("k"), F.col("_t").alias("t")))
    long = keys.select("id", "_nums", F.explode(F.filter(F.array(*each), lambda x: x["k"].isNotNull())).alias("e")).select("id", "e.k", "e.t", F.when(F.col("e.t").isNotNull(), F.col("_nums")).alias("nums"))
    firsts = long.groupBy("k").agg(F.min("id").alias("a"), F.count(F.lit(1)).alias("n"), F.max("t").alias("t"), F.max("nums").alias("nums"))
    if history.whole.exists():
        firsts = firsts.join(history.whole.read().withColumnRenamed("id", "h"), "k", "left")  # one row per key
    else:
        firsts = firsts.withColumn("h", F.lit(None).cast("long"))
    known = checkpoint(firsts)
    lookup = known.where((F.col("n") > 1) | F.col("h").isNotNull()).select("k", F.coalesce("h", "a").alias("a"), "n")
    links = join_hot(long.select("k", "id"), lookup, "k").where("id <> a").select("a", F.col("id").alias("b"))
    return links, known.where("h IS NULL").select("k", F.col("a").alias("id"), "t", "nums")


def _near_links(titles: DataFrame, history: History) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links ``a, b`` of new headlines (``id, t, nums``) with near-copies, and the rows to store, level by level.

    Only hashes and ids are joined; the texts of what meets follow. At each
    level the parts in use are few enough to compare what shares one; the
    headlines of crowded parts go on to the next level, with what is left of
    them (``r``; of the first level it isn't stored, but worked out again).
    """
    titles = checkpoint(titles.where(F.length("t") >= ONE_EDIT))
    seeds = lambda rows: rows.select(F.xxhash64("nums").alias("k"), "id", "t", "nums", F.col("t").alias("r"))
    stored_cuts, asked_cuts = _stored(F.col("r")), _asked(F.col("r"))
    stored, asked = checkpoint(_keys(seeds(titles), stored_cuts)), checkpoint(_keys(seeds(titles), asked_cuts))
    wide: DataFrame | None = None  # of the levels after the first: new rows, and rows of history that a part just split has
    links, appended = [], []
    while True:
        counts = stored.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        had = None
        there = stored.withColumn("old", F.lit(False)) if wide is None else wide.select("k", "id", "old")
        if history.parts.exists():
            wanted = stored.select("k").unionAll(asked.select("k")).distinct()
            had = checkpoint(history.parts.read().join(wanted, "k", "left_semi").distinct())
            counts = counts.join(had.groupBy("k").agg(F.count(F.lit(1)).alias("h")), "k", "full")
            there = there.unionByName(had.select("k", "id", F.lit(True).alias("old")))
        else:
            counts = counts.withColumn("h", F.lit(0))
        n, h = F.coalesce("n", F.lit(0)), F.coalesce("h", F.lit(0))
        crowded = checkpoint(counts.where(n + h > CROWDED).select("k", (h > CROWDED).alias("split")))
        last = not crowded.limit(1).count()
        few = (lambda rows: rows) if last else (lambda rows: rows.join(crowded, "k", "left_anti"))
        texts = titles if had is None else titles.unionByName(had.select("id", "t", "nums").distinct())
        texts = texts if wide is None else texts.unionByName(wide.where("old").select("id", "t", "nums")).distinct()
        links.append(_verified(few(there), few(asked.select("k", "id")), texts, titles))
        fresh = _expand(seeds(titles), stored_cuts).withColumn("r", F.lit(None).cast("string")) if wide is None else wide
        kept = fresh if last else fresh.join(crowded.where("split"), "k", "left_anti")
        appended.append(kept.select("k", "id", "t", "nums", "r"))
        if last:
            return links, appended
        new = (_expand(seeds(titles), stored_cuts).withColumn("old", F.lit(False)) if wide is None else wide).join(crowded.select("k"), "k")
        if had is not None:
            split_now = had.join(crowded.where("NOT split").select("k"), "k")
            if wide is None:
                again = _expand(seeds(split_now.select("id", "t", "nums").distinct()), stored_cuts)
                split_now = again.join(split_now.select("k", "id"), ["k", "id"], "left_semi")
            new = new.unionByName(split_now.withColumn("old", F.lit(True)).select(*new.columns))
        onward = checkpoint(new)
        asking = checkpoint((_expand(seeds(titles), asked_cuts) if wide is None else asked).join(crowded.select("k"), "k"))
        # Where nothing is left that tells headlines apart, they differ by at most EDITS letters each and are few: all are compared.
        done = F.length("r") == 0
        links.append(_verified(onward.where(done).select("k", "id", "old").unionByName(there.where("old").join(onward.where(done).select("k").distinct(), "k").select("k", "id", "old")), asking.where(done).select("k", "id"), texts, titles))
        wide = checkpoint(_split(onward, stored_cuts))
        stored, asked = wide, checkpoint(_split(asking, asked_cuts, EDITS))


def _verified(there: DataFrame, asked: DataFrame, texts: DataFrame, titles: DataFrame) -> DataFrame:
    """Links ``a, b`` between stored (``k, id, old``) and asking (``k, id``) headlines that share a hash and are near; ``texts`` has the stored ones', ``titles`` the asking ones'."""
    x, y = there.alias("x"), asked.alias("y")
    met = x.join(y, (F.col("x.k") == F.col("y.k")) & (F.col("x.id") != F.col("y.id")) & (F.col("x.old") | (F.col("x.id") < F.col("y.id"))))
    pairs = met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()
    one = texts.select(F.col("id").alias("a"), F.col("t").alias("ta"), F.col("nums").alias("na"))
    two = titles.select(F.col("id").alias("b"), F.col("t").alias("tb"), F.col("nums").alias("nb"))
    return pairs.join(one, "a").join(two, "b").where((F.col("na") == F.col("nb")) & is_near(F.col("ta"), F.col("tb"))).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """``id, first``: each linked record other than the first of its component, and that first.

    Large-star and small-star steps in turn until nothing changes: rounds grow
    with the logarithm of the longest chain. Each step is an aggregation and a
    join; no component is ever gathered.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).where("u <> v").distinct())

    def state(e: DataFrame) -> tuple:
        row = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    before = state(edges)
    while before[0]:
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select("v", F.col("m").alias("u")).where("u <> v").distinct()
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(least, "v").select(F.explode(F.array(F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("v"), F.col("m").alias("u")))).alias("e"))
        edges = checkpoint(small.select("e.v", "e.u").where("u <> v").distinct())
        after = state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("v").alias("id"), F.col("u").alias("first"))


def _items_of(ids: DataFrame, history: History) -> DataFrame:
    """``id, item`` of the ids whose item is another record's: labels are followed, bucket by bucket, until they end."""
    if not history.labels.exists():
        return ids.select("id", F.col("id").alias("item")).limit(0)
    labels = history.labels.read().groupBy("id").agg(F.min("first").alias("first"))
    found = checkpoint(ids.join(labels, "id").select("id", F.col("first").alias("item")))
    while True:
        following = found.join(labels.select(F.col("id").alias("item"), F.col("first").alias("_next")), "item", "left")
        moved = checkpoint(following.select("id", F.coalesce("_next", "item").alias("item"), F.col("_next").isNotNull().alias("_moved")))
        found = moved.select("id", "item")
        if not moved.where("_moved").limit(1).count():
            return found


def accept(batch: DataFrame, history: History) -> DataFrame:
    """``first_id, dup_id`` of the batch's records whose item history or an earlier record of the batch had brought; the batch's keys are appended.

    A batch that is held again, such as after a failure between two appends,
    gives the same rows; its whole keys are not stored twice.
    """
    keys = checkpoint(keyed(batch.select("article_id", "source_id", "source_name", "title", "url", "external_id")))
    whole, fresh = _whole_links(keys, history)
    near, parts = _near_links(fresh.where("t IS NOT NULL").select("id", "t", "nums"), history)
    links = checkpoint(reduce(DataFrame.unionAll, near, whole).distinct())
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    items = _items_of(ends, history)
    by = lambda c: items.select(F.col("id").alias(c), F.col("item").alias(f"_{c}"))
    contracted = links.join(by("a"), "a", "left").join(by("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
    labels = checkpoint(components(contracted))
    # The whole keys last: until they are there, a batch that failed counts as new.
    history.labels.append(labels)
    history.parts.append(reduce(DataFrame.unionAll, parts))
    history.whole.append(fresh.select("k", "id"))
    again = items.join(labels.select(F.col("id").alias("item"), "first"), "item", "left").select("id", F.coalesce("first", "item").alias("first"))
    told = labels.unionByName(again).join(keys.select("id").distinct(), "id", "left_semi")
    return told.select(F.col("first").alias("first_id"), F.col("id").alias("dup_id"))


def repeated_items(articles: DataFrame, *, rounds: int = ROUNDS, history: History | None = None) -> DataFrame:
    """``first_id, dup_id``: each record whose item an earlier one (by id) had brought, with the earliest.

    The batches are held against history in order, in ``rounds`` groups of
    successive batches with about as many rows; the groups don't change the
    result. Null or unusable URLs, external ids and titles take part in no
    link; rows without an id are left out, null batches come first; a table
    of one row or none gives an empty result; rows repeated under one id are
    one record.
    """
    spark = articles.sparkSession
    own = history is None
    history = History(spark, scratch(spark, "history")) if own else history
    number = F.coalesce("batch_no", F.lit(-(1 << 31)))
    marks = articles.agg(F.percentile_approx(number, [i / rounds for i in range(1, rounds)] or [1.0])).first()[0] or []
    edges = sorted(set(marks[: rounds - 1]))
    for low, high in zip([None, *edges], [*edges, None], strict=True):
        part = articles if low is None and high is None else articles.where(F.col("batch_no") > low) if high is None else articles.where(((F.col("batch_no") > low) if low is not None else F.col("batch_no").isNull() | F.lit(True)) & (number <= high))
        accept(part, history)
    settled = components(history.labels.read().select(F.col("first").alias("a"), F.col("id").alias("b")))
    if own:
        settled = checkpoint(settled)
        history.drop()
    return settled.select(F.col("first").alias("first_id"), F.col("id").alias("dup_id"))
