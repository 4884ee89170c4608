"""Near duplicates by an exact Jaccard join on word shingles with adaptive prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from feedloom.llm import shingles
from feedloom.llm.common import bounded, written

#: Counters of the frequency sketch (2 to this power): a bounded array whatever the input.
SKETCH_BITS = 18
#: Most matches that a prefix may ask for.
MOST_MATCHES = 4
#: Matches asked for beyond those, where the two sizes demand that many.
MORE_MATCHES = 3
#: Tokens of a document whose buckets give it partners in the first round, and the most
#: partners that a document there stands for.
FIRST_TOKENS = 6
FAN = 64
#: Pairs of a component in a round of heads, and of how many pairs one must be a link for
#: another round.
BEST_HEADS = 3
FEW_LINKS = 50


#: Documents whose words are hashed together: a bound of the arrays that a task holds.
AT_ONCE = 500


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(k, AT_ONCE) for batch in batches for k in range(0, batch.num_rows, AT_ONCE))


def _counted(documents: DataFrame, text: str) -> DataFrame:
    """One row a document: ``th`` (hash of the text), ``n_shingles`` and ``sig``, the name of
    its set (NULL for an empty one); and rows of the frequency sketch, ``bucket`` and ``n``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        shift = np.uint64(64 - SKETCH_BITS)
        seen: set[int] = set()
        names = ["id", "th", "n_shingles", "sig", "bucket", "n"]
        for batch in _slices(batches):
            sizes, labels = [], []
            for own in shingles.sets(batch.column(2)):
                label = shingles.label(own) if len(own) else None
                sizes.append(len(own))
                labels.append(label)
                if label is not None and label not in seen:
                    seen.add(label)
                    np.add.at(sketch, (own >> shift).astype(np.int64), 1)
            none = [None] * len(sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(labels, pa.int64()),
                    pa.array(none, pa.int32()),
                    pa.array(none, pa.int64()),
                ],
                names=names,
            )
        at = np.flatnonzero(sketch)
        if len(at):
            none = [None] * len(at)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(none, id_type),
                    pa.array(none, pa.int64()),
                    pa.array(none, pa.int64()),
                    pa.array(none, pa.int64()),
                    pa.array(at, pa.int32()),
                    pa.array(sketch[at], pa.int64()),
                ],
                names=names,
            )

    source = documents.select("id", F.xxhash64(text).alias("th"), F.col(text).alias("t"))
    id_type = pa.int64()
    schema = "id long, th long, n_shingles long, sig long, bucket int, n long"
    return source.mapInArrow(run, schema)


def prefix(order: np.ndarray, surplus: np.ndarray, percent: int) -> tuple[int, int]:
    """(length, matches) of a document's prefix.

    Documents that are linked share all but ``size - least`` of its tokens, so their
    prefixes of ``size - least + m`` tokens share at least m. Asking for more matches
    lengthens the prefix; the cost of a choice is the surplus of its tokens' buckets, to
    scan them, and the size of the set for each candidate left, at most surplus / m.
    """
    size = len(order)
    least = -(-percent * size // 100)
    base = size - least
    totals = np.cumsum(surplus[: base + MOST_MATCHES])
    choices = range(1, min(MOST_MATCHES, least) + 1)
    matches = min(choices, key=lambda m: totals[base + m - 1] * (1 + size / m))
    return base + matches, matches


def _prefixes(documents: DataFrame, text: str, sketch: np.ndarray, percent: int) -> DataFrame:
    """Rows (tok, sig, info): the prefix of each set, once a task; ``info`` packs the set's
    size, the token's position and the matches asked for. Tokens are ordered by the sketch's
    surplus over what chance puts into its buckets, and then by themselves."""
    middle = np.median(sketch)
    surplus_of = np.maximum(sketch - middle - 3 * np.sqrt(middle) - 1, 0).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.uint64(64 - SKETCH_BITS)
        seen: set[int] = set()
        for batch in _slices(batches):
            toks, sigs, infos = [], [], []
            for own in shingles.sets(batch.column(0)):
                if not len(own):
                    continue
                label = shingles.label(own)
                if label in seen:
                    continue
                seen.add(label)
                surplus = surplus_of[(own >> shift).astype(np.int64)]
                order = np.argsort(surplus, kind="stable")
                length, need = prefix(order, surplus[order], percent)
                toks.append(own[order[:length]])
                n = len(toks[-1])
                sigs.append(np.full(n, label, np.int64))
                infos.append((len(own) << 32) + (np.arange(n) << 3) + need)
            if toks:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(toks).view(np.int64)),
                        *(pa.array(np.concatenate(c)) for c in (sigs, infos)),
                    ],
                    names=["tok", "sig", "info"],
                )

    return documents.select(F.col(text)).mapInArrow(run, "tok long, sig long, info long")


def _shared(prefixes: DataFrame) -> DataFrame:
    """The prefix rows (tok, sig, size, pos, need, rank) whose prefix token another set has
    too; ``rank`` counts such rows of the set before this one. One exchange by token serves
    the removal of repeats and the count."""
    once = prefixes.repartition("tok").groupBy("tok", "sig").agg(F.min("info").alias("info"))
    bucket = Window.partitionBy("tok")
    rows = once.withColumn("df", F.count("*").over(bucket)).filter("df > 1")
    info = F.col("info")
    before = Window.partitionBy("sig").orderBy("pos")
    rows = rows.select(
        "tok",
        "sig",
        F.shiftright(info, 32).cast("int").alias("size"),
        F.shiftright(info.bitwiseAND((1 << 32) - 1), 3).cast("int").alias("pos"),
        info.bitwiseAND(7).cast("int").alias("need"),
    )
    return rows.withColumn("rank", F.row_number().over(before) - 1)


def _sets(documents: DataFrame, text: str, names: DataFrame, members: DataFrame, encode) -> DataFrame:
    """``sig`` and ``data``, the encoded sets of the names in ``names``. Only texts of one
    hash for each name reach Python."""
    wanted = members.join(bounded(names), "sig", "left_semi").groupBy("sig").agg(F.min("th").alias("th"))
    wanted = written(wanted.select("th").distinct(), "wanted-texts", narrow=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in _slices(batches):
            labels, found = [], []
            for own in shingles.sets(batch.column(0)):
                label = shingles.label(own)
                if label not in seen:
                    seen.add(label)
                    labels.append(label)
                    found.append(encode(own))
            yield pa.RecordBatch.from_arrays(
                [pa.array(labels, pa.int64()), pa.array(found, pa.binary())], names=["sig", "data"]
            )

    texts = documents.withColumn("th", F.xxhash64(text)).join(bounded(wanted), "th", "left_semi")
    sets = texts.select(text).mapInArrow(run, "sig long, data binary")
    return sets.groupBy("sig").agg(F.first("data").alias("data"))


def _compared(pairs: DataFrame, sets: DataFrame, test) -> DataFrame:
    """The pairs (a, b) whose encoded sets pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(batch.column(2), batch.column(3))
            keep = pa.array([test(x.as_py(), y.as_py()) for x, y in found], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    left = sets.select(F.col("sig").alias("a"), F.col("data").alias("x"))
    right = sets.select(F.col("sig").alias("b"), F.col("data").alias("y"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return joined.mapInArrow(run, "a long, b long")


def _links(
    documents: DataFrame, text: str, pairs: DataFrame, members: DataFrame, percent: int
) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough: first by few bits of each shingle,
    which can only say no, then by all."""

    def exact(x: bytes, y: bytes) -> bool:
        return shingles.linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent)

    def rough(x: bytes, y: bytes) -> bool:
        return shingles.may_link(x, y, percent)

    for encode, test in ((shingles.coarse, rough), (lambda own: own.tobytes(), exact)):
        pairs = written(pairs, "pairs", narrow=True)
        names = pairs.select(F.explode(F.array("a", "b")).alias("sig")).distinct()
        names = written(names, "names", narrow=True)
        pairs = _compared(pairs, _sets(documents, text, names, members, encode), test)
    return written(pairs, "links", narrow=True)


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the component's smallest node) for every node of the links.

    Each round every node moves to the smallest node it is linked with; moved links keep the
    components, and the nodes that stay are fewer by half at least in a connected part.
    """
    edges = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = written(edges.filter("a <> b").distinct(), "edges", narrow=True)
    labels = None
    while not edges.isEmpty():
        moves = edges.groupBy("a").agg(F.min("b").alias("m"))
        moves = written(moves.select("a", F.least("a", "m").alias("m")), "moves", narrow=True)
        if labels is None:
            labels = moves.select(F.col("a").alias("node"), F.col("m").alias("root"))
        else:
            step = moves.select(F.col("a").alias("root"), "m")
            labels = labels.join(step, "root", "left").select(
                "node", F.coalesce("m", "root").alias("root")
            )
        labels = written(labels, "labels", narrow=True)
        to = moves.select(F.col("a").alias("b"), F.col("m").alias("mb"))
        edges = edges.join(moves, "a").join(to, "b").select(F.col("m").alias("a"), F.col("mb").alias("b"))
        edges = written(edges.filter("a <> b").distinct(), "edges", narrow=True)
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    return labels


def _room(percent: int, matches) -> Column:
    """Whether a match, one of the first ``matches`` of two linked sets, leaves enough behind
    it: of the least overlap o, with o * (100 + percent) >= percent * (both sizes), all but
    ``matches`` - 1 lie at it and after it; and of those before it, which are in both prefixes,
    there are no more than either ``rank``. And whether the sizes can be linked at all."""
    matches = F.lit(matches) if isinstance(matches, int) else matches
    rest = F.least(F.col("size") - F.col("pos"), F.col("s_size") - F.col("s_pos"))
    rest = rest + F.least(matches - 1, F.col("rank"), F.col("s_rank"))
    enough = rest * (100 + percent) >= (F.col("size") + F.col("s_size")) * percent
    sized = F.least("size", "s_size") * 100 >= F.greatest("size", "s_size") * percent
    return enough & sized


def _neighbours(shared: DataFrame, percent: int) -> DataFrame:
    """Pairs to try first; only a start, no link depends on it.

    Of tokens that a partner of its own size would share, each document takes a few by hash.
    In a bucket, documents that share more stand first, and each is compared with the one at
    its place divided by FAN: those at the head are closest to what a group has in common,
    and none meets more than FAN others.
    """
    near = (F.col("size") - F.col("pos")) * (100 + percent) >= 2 * percent * F.col("size")
    own = Window.partitionBy("sig")
    near = shared.filter(near).withColumns(
        {"k": F.row_number().over(own.orderBy(F.xxhash64("tok"), "tok")), "shares": F.count("*").over(own)}
    )
    line = Window.partitionBy("tok").orderBy(F.desc("shares"), F.xxhash64("tok", "sig"), "sig")
    placed = near.withColumn("place", F.row_number().over(line) - 1)
    heads = placed.select("tok", F.col("place").alias("head"), *[F.col(c).alias(f"s_{c}") for c in ("sig", "size", "pos", "rank")])
    few = placed.filter((F.col("k") <= FIRST_TOKENS) & (F.col("place") > 0))
    few = few.withColumn("head", F.floor(F.col("place") / FAN).cast("int"))
    pairs = few.join(heads, ["tok", "head"]).filter(_room(percent, 1 + MORE_MATCHES))
    return pairs.select(F.least("sig", "s_sig").alias("a"), F.greatest("sig", "s_sig").alias("b")).distinct()


def _buckets(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the buckets (tokens) in which several components meet, with their ``root``
    and the bucket's largest component, ``large``. Buckets are summed up a component at a
    time, so one of very many rows is no task's."""
    sizes = roots.groupBy("root").agg(F.count("*").alias("members"))
    rows = shared.join(roots, shared.sig == roots.node, "left").drop("node")
    rows = rows.withColumn("root", F.coalesce("root", "sig")).join(sizes, "root", "left")
    parts = rows.groupBy("tok", "root").agg(F.coalesce(F.max("members"), F.lit(1)).alias("m"))
    largest = F.max(F.struct("m", "root"))["root"].alias("large")
    met = parts.groupBy("tok").agg(largest, F.count("*").alias("parts")).filter("parts > 1").drop("parts")
    return rows.drop("members").join(met, "tok")


def _heads(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) to try before the exact round; no link depends on it.

    In a bucket every component sends the one member for which most can still match, and
    those of the others meet that of the largest. A component tries the few it met most.
    """
    first = F.max(F.struct((F.col("size") - F.col("pos") + F.col("rank")).alias("rest"), "sig", "size", "pos", "rank"))
    sent = buckets.groupBy("tok", "root", "large").agg(first.alias("f"))
    lead = sent.filter("root = large").select("tok", *[F.col("f")[c].alias(c) for c in ("sig", "size", "pos", "rank")])
    seek = sent.filter("root <> large").select("tok", "root", *[F.col("f")[c].alias(f"s_{c}") for c in ("sig", "size", "pos", "rank")])
    met = seek.join(lead, "tok").filter(_room(percent, 1 + MORE_MATCHES))
    pairs = met.groupBy("root", F.least("sig", "s_sig").alias("a"), F.greatest("sig", "s_sig").alias("b"))
    pairs = pairs.agg(F.count("*").alias("met"))
    most = Window.partitionBy("root").orderBy(F.desc("met"), "a", "b")
    pairs = pairs.withColumn("k", F.row_number().over(most)).filter(F.col("k") <= BEST_HEADS)
    return pairs.select("a", "b").distinct()


def _met(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of members of different components, once for each of their tokens that
    leaves room for a link, and the ``matches`` such a pair needs.

    Of two linked sets the one whose prefix ends first has all but size - length of their
    least overlap in both prefixes. So a pair has to share that many prefix tokens (here up
    to MORE_MATCHES more than the less demanding of the two asks for), each at positions that
    leave room for the rest. In a bucket the members of its largest component are not
    paired with each other, so only its other members look for partners.
    """
    columns = ("sig", "size", "pos", "need", "rank", "root")
    seek = buckets.filter("root <> large").select("tok", *[F.col(c).alias(f"s_{c}") for c in columns], "large")
    rows = buckets.drop("large")

    def outside(prefix: str) -> Column:
        """Tokens behind a document's prefix."""
        return F.floor((percent * F.col(f"{prefix}size") + 99) / 100) - F.col(f"{prefix}need")

    overlap = F.floor((percent * (F.col("size") + F.col("s_size")) + 99 + percent) / (100 + percent))
    full = overlap - F.greatest(outside(""), outside("s_"))
    matches = F.least(full, F.least("need", "s_need") + MORE_MATCHES).cast("int")
    # of two seekers one does: the one with the larger name
    turn = (F.col("root") == F.col("large")) | (F.col("s_sig") > F.col("sig"))
    met = seek.join(rows, "tok").filter((F.col("root") != F.col("s_root")) & turn & _room(percent, matches))
    return met.select(F.least("sig", "s_sig").alias("a"), F.greatest("sig", "s_sig").alias("b"), matches.alias("matches"))


def _candidates(buckets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that share enough tokens to be linked."""
    found = _met(buckets, percent).groupBy("a", "b").agg(F.count("*").alias("met"), F.min("matches").alias("matches"))
    return found.filter("met >= matches").select("a", "b")


def _contracted(
    documents: DataFrame, text: str, shared: DataFrame, found: DataFrame, members: DataFrame, percent: int
) -> tuple[DataFrame, DataFrame]:
    """The links (a, b) after rounds of heads, and the buckets that are left.

    Each round joins what its heads link, so a group of near copies is one component, or
    nearly, before members are paired. Rounds end when one links few of the pairs it tried.
    """
    tried = None
    while True:
        buckets = written(_buckets(shared, components(found)), "buckets")
        pairs = _heads(buckets, percent)
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = written(pairs, "heads", narrow=True)
        links = _links(documents, text, pairs, members, percent)
        n = links.count()
        if not n:
            return found, buckets
        found = found.union(links)
        tried = pairs if tried is None else tried.union(pairs)
        if n * FEW_LINKS < pairs.count():
            return found, written(_buckets(shared, components(found)), "buckets")


def near_duplicates(
    documents: DataFrame, text: str = "text", id: str = "doc_id", percent: int = 75
) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` of every document, row by row.

    A text's set is its distinct windows of five words (runs of other than ASCII white
    space, A to Z lowered), all its words if they are fewer. Two documents are linked when
    100 * |intersection| >= percent * |union|; ``component_id`` is the smallest id that links
    reach. NULL texts and texts without words have empty sets and are linked with nothing:
    a component of their own. Equal texts are linked; repeated rows stay rows. A NULL id
    counts in no minimum; a document linked to no id has a NULL component. Shingles are
    compared by 64-bit hashes, whole sets by a 64-bit name.

    Equal sets are one class, and all that follows is between classes. Neighbours in a few
    buckets are compared first, which joins large groups, then one head of each component in
    every bucket, round by round; the prefix join looks at pairs of different components
    only, so a group of near copies costs its size, not its square.
    """
    docs = documents.select(F.col(id).cast("long").alias("id"), F.col(text).alias("t"))
    counted = written(_counted(docs, "t"), "shingle-counts")
    members = counted.filter("bucket is null").select("id", "th", "n_shingles", "sig")
    sketch = np.zeros(1 << SKETCH_BITS, np.int64)
    # at most 2 ** SKETCH_BITS rows
    sums = counted.filter("bucket is not null").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    sketch[sums["bucket"].to_numpy()] = sums["n"].to_numpy()
    shared = written(_shared(_prefixes(docs, "t", sketch, percent)), "shared-prefixes")
    found = _links(docs, "t", _neighbours(shared, percent), members, percent)
    found, buckets = _contracted(docs, "t", shared, found, members, percent)
    rest = _links(docs, "t", _candidates(buckets, percent), members, percent)
    roots = components(found.union(rest))
    rooted = members.join(roots, members.sig == roots.node, "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "sig"))
    least = rooted.filter("root is not null").groupBy("root").agg(F.min("id").alias("component_id"))
    joined = rooted.join(least, "root", "left")
    component = F.when(F.col("sig").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"))


def representatives(documents: DataFrame, text: str = "text", id: str = "doc_id", percent: int = 75) -> DataFrame:
    """One row of each component: that of the smallest id, rows without an id last, and of
    rows that repeat it one. Documents with empty sets all stay."""
    # written once, so that a row keeps its number
    rows = written(documents.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    found = near_duplicates(rows, text, "__row", percent).select("__row", "component_id")
    ids = rows.select("__row", F.col(f"`{id}`").alias("id"))
    found = written(found.join(ids, "__row"), "named-rows", narrow=True)
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "__row"))["__row"].alias("first")
    first = found.groupBy("component_id").agg(first, F.count("*").alias("n")).filter("n > 1").drop("n")
    first = written(first, "first-rows", narrow=True)
    gone = found.join(bounded(first), "component_id").filter(F.col("__row") != F.col("first"))
    gone = written(gone.select("__row"), "copies", narrow=True)
    return rows.join(bounded(gone), "__row", "left_anti").select(*[F.col(f"`{c}`") for c in documents.columns])
