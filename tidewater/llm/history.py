"""Checking new batches of items against everything accepted before: a pivot-distance table of headlines.

A headline is the set of its canonical words. The distance of two headlines is the summed weight of the words that only
one of them has (with multiplicity), which is a metric. Identifying words (names, figures) weigh SCALE times a fixed large
number of their own, ordinary words 1, so that headlines within RADIUS have the same names and figures and differ in a few
ordinary words.

The table stores every headline's distance to the empty headline and, packed in one number, the words it shares with
PIVOTS further pivots, each a fixed class of the ordinary words. By the triangle inequality the distances to the empty
headline differ by at most RADIUS within RADIUS; as the classes have no word in common, even the sum of the differences
over all of them does. History lies in folders by range of the first distance, sorted by it. A batch reads the ranges that
it reaches, joins there on narrow cells of the distance, prunes by all pivots, computes the true distance of what is left,
and lets an alignment of the words decide. What a batch adds is appended.

What is ordinary is counted over everything accepted so far. The counts are stored and summed up; where a batch makes
further words ordinary, the stored headlines that hold them, and only these, get new distances and are compared again.
"""

from __future__ import annotations

import difflib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.headline import ESTABLISHED, LABEL_MARK, TITLES_MARK, Lexicon, grown_lexicon, key64, one_slip, part_of, shortened, url_key, weight, word_counts
from tidewater.runtime import drop_path, folders, new_path, written, written_at

SCALE = 64
RADIUS = 6
#: Pivots besides the empty headline; four bits each.
PIVOTS = 15
#: A cell with more headlines than this is first split by the rarer ordinary words (exact: see _split).
CROWDED = 200
#: Summed weights of identifying words are kept modulo this, so that distances of headlines of any length fit 64 bits. Within
#: RADIUS these sums are equal, so they stay equal and nothing is lost; what meets by chance is refused by the true distance.
MODULUS = 1 << 56
#: Where weights begin in the sums of places: no headline has more ordinary words than fit below.
WEIGHT_AT = 4 * PIVOTS + 60
#: Folders of the stored distances; the sums of weights are spread evenly over them.
RANGES = 16
RANGE_BITS = (SCALE * MODULUS).bit_length() - 1 - (RANGES.bit_length() - 1)
ITEM_SCHEMA = "obs_id long, s long, u long, d0 long, p long, t string, raw string, past string"
ROW_TYPES = {c: pa.int64() if kind == "long" else pa.string() for c, kind in map(str.split, ITEM_SCHEMA.split(", "))}


class Places(dict):
    """By word what it adds to one number: from the lowest bits up the words shared with each of the pivots, the ordinary
    words, and the weights of identifying words."""

    def __init__(self, lexicon: Lexicon) -> None:
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        at = self[word] = 1 << 4 * PIVOTS | 1 << 4 * part_of(word, PIVOTS) if self.lexicon.ordinary(word) else weight(word) << WEIGHT_AT
        return at


def placed(words: list[str], places: Places) -> tuple[int, int]:
    """Distance to the empty headline, and the packed numbers of words shared with the other pivots (at most 15 are told
    apart, which still bounds differences from below)."""
    summed = sum(map(places.__getitem__, words))
    heavy, light, packed = summed >> WEIGHT_AT, (summed & (1 << WEIGHT_AT) - 1) >> 4 * PIVOTS, summed & (1 << 4 * PIVOTS) - 1
    if light > 15:
        # a class may have run over its four bits, and into the number of words
        ordinary = [w for w in words if not places[w] >> WEIGHT_AT]
        shared = Counter(part_of(w, PIVOTS) for w in ordinary)
        light, packed = len(ordinary), sum(min(n, 15) << 4 * i for i, n in shared.items())
    heavy = (heavy - 1) % MODULUS + 1 if heavy else 0
    return SCALE * heavy + light, packed


def item_rows(items: DataFrame, lexicon: Lexicon) -> DataFrame:
    """obs_id, s (key of the canonical headline), u (key of the address), d0 (distance to the empty headline), p (words
    shared with the other pivots), t (the canonical headline), raw (the title), past (its label, and words taken for slips).

    An item without a usable headline has its address as headline key, one with neither a key of its own; a NULL ``u``
    is no address.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(lexicon)
        for batch in batches:
            out = []
            for obs, title, url in zip(*(batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("obs_id", "title", "url"))):
                address = url_key(url) if url is not None else None
                u = key64("a " + address) if address else None
                words, label, slips = lexicon.parsed(title) if title is not None else ([], "", [])
                if not words:
                    out.append((obs, u if u is not None else key64(f"o {obs}"), u, None, 0, None, None, None))
                    continue
                d0, p = placed(words, places)
                text = " ".join(words)
                out.append((obs, key64(text), u, d0, p, text, title, " ".join([LABEL_MARK + label.replace(" ", "_"), *slips])))
            if out:
                yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*out), ROW_TYPES.values())], names=list(ROW_TYPES))

    return items.select(F.col("obs_id").cast("long"), F.col("title").cast("string"), F.col("url").cast("string")).mapInArrow(rows, ITEM_SCHEMA)


def operations(a: list[str], b: list[str]) -> list[tuple[list[str], list[str], bool]]:
    """The parts of ``a`` and ``b`` that stand against each other between equal words, after a common beginning and end,
    and whether they are the first or the last words of both."""
    lo, end = 0, min(len(a), len(b))
    while lo < end and a[lo] == b[lo]:
        lo += 1
    hi = 0
    while hi < end - lo and a[-1 - hi] == b[-1 - hi]:
        hi += 1
    a, b = a[lo : len(a) - hi], b[lo : len(b) - hi]
    if not a or not b:
        return [(a, b, not lo or not hi)] if a or b else []
    codes = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return [(a[i:j], b[k:m], (not lo and i == k == 0) or (not hi and j == len(a) and m == len(b))) for op, i, j, k, m in codes if op != "equal"]


def same_story(a: list[str], b: list[str], lexicon: Lexicon) -> bool:
    """Whether two headlines with the same identifying words within RADIUS differ in wording only.

    Words may be left out, added, or replaced by a similar or by a rare ordinary word; an ordinary word in the place of
    another one that is as established is another subject, also where the one is left out and the other added elsewhere
    inside of the headline.
    """
    share = lambda w: lexicon.shares.get(w, 0)
    gone: Counter[str] = Counter()
    come: Counter[str] = Counter()
    for x, y, outer in operations(*sorted((a, b))):
        if not x or not y:
            if not outer:
                gone.update(x)
                come.update(y)
        elif len(x) == len(y) and all(difflib.SequenceMatcher(None, p, q).ratio() > 0.8 or min(share(p), share(q)) < lexicon.established for p, q in zip(x, y)):
            pass
        elif len(x) == len(y) or max(len(x), len(y)) > 3 or min(map(share, x + y)) >= lexicon.established:
            return False
    return not all(any(share(w) >= lexicon.established for w in part) for part in (gone - come, come - gone))


def true_distance(a: list[str], b: list[str], lexicon: Lexicon) -> int:
    """The metric itself."""
    x, y = Counter(a), Counter(b)
    return sum(n * (1 if lexicon.ordinary(w) else SCALE * weight(w)) for w, n in ((x - y) + (y - x)).items())


def within(a: list[str], b: list[str], lexicon: Lexicon) -> bool:
    """Whether two headlines are within the radius: RADIUS, or half of their ordinary words if these are fewer, so that
    short headlines share some."""
    return 2 * true_distance(a, b, lexicon) <= min(2 * RADIUS, sum(map(lexicon.ordinary, a)) + sum(map(lexicon.ordinary, b)))


def _split(lexicon: Lexicon, schema: str):
    """Adds ``keys``: the RADIUS + 1 rarest of a headline's ordinary words, counted apart where one stands repeatedly.

    Two headlines within the radius share at least one of them: of sizes m <= n they have at least (m + n - RADIUS) / 2
    words in common, and never none, so some common word is among the m - common + 1 rarest of the one and the n - common
    + 1 rarest of the other, and both are RADIUS + 1 at most. Headlines of identifying words only must be equal as sets.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keys = []
            for t in batch["t"]:
                words = t.split(" ")
                counted = Counter(w for w in words if lexicon.ordinary(w))
                light = sorted(((lexicon.shares[w], w, i) for w, n in counted.items() for i in range(n)))[: RADIUS + 1]
                keys.append([key64(f"{i} {w}") for _, w, i in light] or [key64("all " + " ".join(sorted(words)))])
            yield batch.assign(keys=keys)

    return rows, schema + ", keys array<bigint>"


def _pruned(a: str, b: str) -> Column:
    """What the triangle inequality leaves: distances to the empty headline within RADIUS, and the differences of words
    shared with the other pivots, summed over them, too."""
    apart = sum((F.abs(F.shiftright(a + "p", 4 * i).bitwiseAND(15) - F.shiftright(b + "p", 4 * i).bitwiseAND(15)) for i in range(PIVOTS)), F.lit(0))
    return (F.abs(F.col(a + "d0") - F.col(b + "d0")) <= RADIUS) & (apart <= RADIUS)


def cell_of(d0: Column) -> Column:
    return F.shiftright(d0, SCALE.bit_length() - 1)


def range_of(d0: Column) -> Column:
    return F.shiftright(d0, RANGE_BITS).cast("int")


def candidates(fresh: DataFrame, known: DataFrame | None, lexicon: Lexicon) -> DataFrame:
    """a, b, a_s, b_s: pairs of fresh x known and fresh x fresh headlines that no pivot rules out.

    fresh, known: node, s, d0, p, t; one row per headline. A row looks in the one or two cells that the interval of RADIUS
    around its distance meets; cells without another headline end at the join. Only numbers travel, but in crowded cells.
    """
    cols = ["node", "s", "d0", "p", "t"]
    here = fresh.select(*cols, F.lit(True).alias("new"))
    stored = (here if known is None else here.unionByName(known.select(*cols, F.lit(False).alias("new")))).withColumn("cell", cell_of(F.col("d0")))
    looking = here.withColumn("cell", F.explode(F.array_distinct(F.array(cell_of(F.col("d0") - RADIUS), cell_of(F.col("d0") + RADIUS)))))
    # at most one cell in CROWDED headlines
    crowded = written(stored.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED).select("cell"), "crowded")

    def side(df: DataFrame, name: str, by: list[str]) -> DataFrame:
        return df.select(*by, *[F.col(c).alias(f"{name}_{c}") for c in df.columns if c not in by])

    order = [F.struct(*[f"{x}_{c}" for c in ("d0", "s", "node")]) for x in "ab"]
    near = ~(F.col("b_new") & (order[0] <= order[1])) & _pruned("a_", "b_")
    out = [F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_s", "b_s"]
    few = side(looking.join(crowded, "cell", "left_anti").drop("t", "new"), "a", ["cell"]).join(side(stored.drop("t"), "b", ["cell"]), "cell").where(near).select(*out)
    split, schema = _split(lexicon, "cell long, node long, s long, d0 long, p long, t string, new boolean")
    parts = [side(df.join(crowded, "cell", "left_semi").select("cell", *cols, "new").mapInPandas(split, schema).withColumn("key", F.explode("keys")).drop("t"), x, ["cell", "key"]) for x, df in (("a", looking), ("b", stored))]
    # a pair that shares several keys is taken at the first of them
    first = F.array_min(F.array_intersect("a_keys", "b_keys")) == F.col("key")
    many = parts[0].join(parts[1], ["cell", "key"]).where(near & first).select(*out)
    return few.unionByName(many)


def verified(pairs: DataFrame, fresh: DataFrame, known: DataFrame | None, lexicon: Lexicon) -> DataFrame:
    """a, b of the candidates within the true distance whose words differ in wording only."""
    texts = fresh.select("s", "t") if known is None else fresh.select("s", "t").unionByName(known.select("s", "t"))
    pairs = written(pairs, "pairs")  # few, so their size decides how the words are joined to them
    # the same words for either side, so that they are shuffled once; a headline that is fresh and known only gives its pairs again
    pairs = pairs.join(texts.select(F.col("s").alias("b_s"), F.col("t").alias("b_t")), "b_s").join(texts.select(F.col("s").alias("a_s"), F.col("t").alias("a_t")), "a_s")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for t, v in zip(batch["a_t"], batch["b_t"]):
                a, b = t.split(" "), v.split(" ")
                keep.append(t == v or sorted(a) == sorted(b) or (within(a, b, lexicon) and same_story(a, b, lexicon)))
            if any(keep):
                yield batch.loc[keep, ["a", "b"]]

    return pairs.select("a", "b", "a_t", "b_t").mapInPandas(verify, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the smallest node of every connected component of the edges a, b.

    Minimum labels travel along the edges and are shortened through their own roots; every round is a written table, so
    that neither a lost executor nor a long chain costs more than its round, and goes when the next one stands. Only nodes
    that have an edge take part.
    """
    spark = edges.sparkSession
    both, edge_path = written_at(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = written_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "labels")
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("seen"))
        stepped = labels.join(spread, "node").select("node", F.col("root").alias("old"), F.least("root", "seen").alias("step"))
        roots = labels.select(F.col("node").alias("step"), F.col("root").alias("far"))
        fresh, new = written_at(stepped.join(roots, "step", "left").select("node", "old", F.least("step", F.coalesce("far", "step")).alias("root")), "labels")
        changed = fresh.where(F.col("root") != F.col("old")).limit(1).count()
        drop_path(spark, path)
        labels, path = fresh.select("node", "root"), new
        if not changed:
            drop_path(spark, edge_path)
            return labels


def headlines(rows: DataFrame) -> DataFrame:
    """s, node (the first item that has it), d0, p, t of every canonical headline. Copies collapse on the map side."""
    return rows.groupBy("s").agg(F.min("obs_id").alias("node"), *[F.first(c).alias(c) for c in ("d0", "p", "t")])


def address_links(rows: DataFrame) -> DataFrame:
    """a, b: the nodes of every address (u, node), each with the smallest."""
    ends = rows.groupBy("u").agg(F.min("node").alias("a"), F.max("node").alias("z")).where(F.col("a") != F.col("z"))
    return rows.join(ends, "u").where(F.col("node") != F.col("a")).select("a", F.col("node").alias("b"))


STORED = {
    "words": "word string, n long, low long",
    "items": "obs_id long, s long, u long, story long",
    "texts": ITEM_SCHEMA,
    "heads": "s long, story long, d0 long, p long, t string, range int",
    "merged": "story long, now long",
    "lexicon": "word string, share double, capital boolean",
}


class History:
    """The accepted items in the shared folder, to which batches are compared and appended.

    Tables by batch: ``words`` (counts), ``texts`` (titles as they came, with their headlines then), ``items`` (obs_id, s, u,
    story), ``heads`` (the pivot-distance table, in folders by range of the distance), ``merged`` (stories that turned out to be told before), ``lexicon`` (what is ordinary so far; written last). A story is
    named by the smallest obs_id that tells it. A history may be opened again by its path; a batch that failed is run again
    and replaces what it had written. A ``lexicon`` that is given is kept instead of being learnt.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, lexicon: Lexicon | None = None) -> None:
        self.spark, self.path, self.batches = spark, path or new_path(spark, "history"), 0
        self.lexicon, self.given = lexicon, lexicon is not None
        if path is not None:
            self.batches = len(folders(spark, f"{path}/lexicon"))
        if self.batches and not self.given:
            rows = self.spark.read.schema(STORED["lexicon"]).parquet(f"{self.path}/lexicon/batch={self.batches - 1}").collect()  # bounded as a lexicon is
            words = [r for r in rows if r.word[0] != LABEL_MARK]
            self.lexicon = Lexicon({r.word: r.share for r in words}, {r.word for r in words if r.capital}, {r.word[1:] for r in rows if r.word[0] == LABEL_MARK}, ESTABLISHED)

    def _write(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        path = f"{self.path}/{name}/batch={self.batches}"
        writer = df.write.mode("overwrite")
        (writer.partitionBy(by) if by else writer).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _before(self, name: str) -> DataFrame:
        """What earlier batches stored."""
        paths = [f"{self.path}/{name}/batch={b}" for b in range(self.batches)]
        return self.spark.read.schema(STORED[name] + ", batch int").option("basePath", f"{self.path}/{name}").parquet(*paths).drop("batch")

    def _learn(self, items: DataFrame) -> tuple[Lexicon, DataFrame | None]:
        """The lexicon after this batch, and the words and labels that stored headlines must not hold any longer (None if
        there are none): those that became ordinary, and those one slip away from such."""
        before = self.lexicon
        if self.given:
            return before, None
        counts = self._write(word_counts(items), "words")
        if self.batches:
            counts = self._before("words").unionByName(counts)
        lexicon = grown_lexicon(counts, before)
        if not self.batches:
            return lexicon, None
        words, labels = lexicon.shares.keys() - before.shares.keys(), lexicon.labels - before.labels
        target = words | (lexicon.capital - before.capital)
        if not target and not labels:
            return lexicon, None
        near = shortened(target)

        def stale(word: str) -> bool:
            if word in words or (word[0] == LABEL_MARK and word[1:] in labels):
                return True
            return word not in before.shares and len(word) > 3 and word.isalpha() and any(one_slip(word, v) for cut in shortened([word]) for v in near.get(cut, ()))

        def pick(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                yield batch.loc[[stale(w) for w in batch["word"]]]

        return lexicon, counts.where(F.col("word") != TITLES_MARK).select("word").mapInPandas(pick, "word string").select(F.replace("word", F.lit(" "), F.lit("_")).alias("word")).distinct()

    def _present(self, df: DataFrame, column: str) -> DataFrame:
        """``df`` with the stories in ``column`` replaced by those that they were merged into."""
        merged = self.spark.read.schema(STORED["merged"]).parquet(f"{self.path}/merged/batch={self.batches - 1}")
        return df.join(merged.select(F.col("story").alias(column), "now"), column, "left").withColumn(column, F.coalesce("now", column)).select(*df.columns)

    def _moved(self, stale: DataFrame, lexicon: Lexicon) -> DataFrame:
        """The stored headlines that hold stale words, with their new distances. What they were stays stored: it is found
        less often, and the true distance is taken by the present lexicon anyhow."""
        # each is written, so that its size is known before all stored words or titles are shuffled to meet it
        stale = written(stale, "stale")
        texts = self._before("texts").where(F.col("t").isNotNull())
        held = texts.select("obs_id", F.explode(F.array_union(F.split("t", " "), F.split("past", " "))).alias("word")).join(stale, "word", "left_semi").select("obs_id").distinct()
        held = written(held, "held")
        told = self._present(self._before("items").select("obs_id", "story").join(held, "obs_id", "left_semi"), "story")
        again = texts.select("obs_id", F.col("raw").alias("title")).join(held, "obs_id", "left_semi").join(told, "obs_id").select(F.col("story").alias("obs_id"), "title", F.lit(None).cast("string").alias("url"))
        return headlines(item_rows(again, lexicon).where(F.col("t").isNotNull()))

    def _known(self, fresh: DataFrame) -> DataFrame:
        """The stored headlines of the ranges and cells that ``fresh`` reaches, with their present story as node."""
        around = fresh.select(F.explode(F.array(F.col("d0") - RADIUS, F.col("d0") + RADIUS)).alias("d0"))
        reached = [r[0] for r in around.select(range_of(F.col("d0"))).distinct().collect()]  # at most RANGES numbers
        cells = around.select(cell_of(F.col("d0")).alias("cell")).distinct()
        heads = self._before("heads").where(F.col("range").isin(reached)).withColumn("cell", cell_of(F.col("d0"))).join(cells, "cell", "left_semi")
        return self._present(heads.select("s", F.col("story").alias("node"), "d0", "p", "t"), "node")

    def append(self, items: DataFrame) -> DataFrame:
        """Compare a batch (obs_id, title, url) with all accepted items and with itself, and accept it.

        Returns first_obs_id, obs_id: every item of the batch that tells a story already told by a smaller obs_id, and
        every earlier item whose first item is another one now, because the batch joined two stories. Items are one story
        if they share an address, share a canonical headline, have headlines within the radius that differ in wording
        only, or are connected by such items. NULL, empty and unusable titles and addresses never match each other; exact
        copies are collapsed before anything is compared and each still gets its row; rows with one obs_id are one item;
        an empty batch gives nothing; further columns are ignored.
        """
        spark, scratch = self.spark, []

        def cut(df: DataFrame, label: str) -> DataFrame:
            df, path = written_at(df, label)
            scratch.append(path)
            return df

        lexicon, stale = self._learn(items)
        rows = self._write(item_rows(items, lexicon), "texts")
        # a node is the smallest obs_id of a headline in this batch, or that of an earlier story
        heads = cut(headlines(rows), "heads")
        titled, known, told = heads.where(F.col("t").isNotNull()), None, None
        own = rows.where(F.col("u").isNotNull()).select("u", "s").distinct().join(heads.select("s", "node"), "s").select("u", "node")
        if self.batches:
            if stale is not None:
                titled = titled.unionByName(cut(self._moved(stale, lexicon), "moved"))
            known = cut(self._known(titled), "known")
            told = self._before("items").join(own.select("u").distinct(), "u", "left_semi").groupBy("u").agg(F.min("story").alias("node"), F.max("story").alias("other"))
            told = self._present(told.select("u", F.explode(F.array("node", "other")).alias("node")), "node")
        edges = verified(candidates(titled, known, lexicon), titled, known, lexicon)
        edges = edges.unionByName(address_links(own if told is None else own.unionByName(told)))
        roots = components(edges.where(F.col("a") != F.col("b")))
        stories = heads.select("s", "node").join(roots, "node", "left").select("s", F.coalesce("root", "node").alias("story"))
        kept = self._write(rows.select("obs_id", "s", "u").join(stories, "s").select("obs_id", "s", "u", "story"), "items")
        out = kept.where(F.col("story") < F.col("obs_id")).select(F.col("story").alias("first_obs_id"), "obs_id")
        if self.batches:
            moves = written(roots.where(F.col("root") != F.col("node")).join(rows.select(F.col("obs_id").alias("node")), "node", "left_anti"), "moves")
            merged = self.spark.read.schema(STORED["merged"]).parquet(f"{self.path}/merged/batch={self.batches - 1}")
            older = merged.join(moves.select(F.col("node").alias("now"), "root"), "now", "left").select("story", F.coalesce("root", "now").alias("now"))
            merged = self._write(older.unionByName(moves.select(F.col("node").alias("story"), F.col("root").alias("now"))), "merged")
            changed = merged.join(moves.select(F.col("root").alias("now")).distinct(), "now", "left_semi")
            again = self._before("items").join(changed, "story").where(F.col("now") < F.col("obs_id"))
            out = out.unionByName(again.select(F.col("now").alias("first_obs_id"), "obs_id"))
        else:
            self._write(spark.createDataFrame([], STORED["merged"]), "merged")
        add = titled.join(roots, "node", "left").select("s", F.coalesce("root", "node").alias("story"), "d0", "p", "t", range_of(F.col("d0")).alias("range"))
        if known is not None:
            add = add.join(known.select("s"), "s", "left_anti")
        self._write(add.repartition(RANGES, "range").sortWithinPartitions("range", "d0"), "heads", "range")
        self.lexicon = lexicon
        self._write(self._words_of(lexicon), "lexicon")
        self.batches += 1
        for path in scratch:
            drop_path(spark, path)
        return out

    def _words_of(self, lexicon: Lexicon) -> DataFrame:
        rows = [(w, x, w in lexicon.capital) for w, x in lexicon.shares.items()] + [(LABEL_MARK + x, 0.0, False) for x in lexicon.labels]
        return self.spark.createDataFrame(rows, STORED["lexicon"]).coalesce(1)

    def repeats(self) -> DataFrame:
        """first_obs_id, obs_id of every accepted item that repeats a story, as things now stand."""
        if not self.batches:
            return self.spark.createDataFrame([], "first_obs_id long, obs_id long")
        told = self._present(self._before("items").select("obs_id", "story"), "story")
        return told.where(F.col("story") < F.col("obs_id")).select(F.col("story").alias("first_obs_id"), "obs_id")


def repeats(items: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """first_obs_id, obs_id of a table that is the first batch of a history; see :meth:`History.append`."""
    return History(items.sparkSession, lexicon=lexicon).append(items)
