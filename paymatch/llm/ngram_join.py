"""N-gram Jaccard join (operator 7): blocks of rare shingles, and in each block trees of token bit maps and size ranges."""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paymatch.llm import sketches
from paymatch.llm.components import components
from paymatch.llm.words import gram_hashes, mix, signed, space_words
from paymatch.plans.runtime import release, stage

LEAF, FAN = 32, 8  # rows in a leaf of a tree, children of a node
PART = 4096  # rows of a block in one task at most, against as many others
MEMBERS = 1 << 22  # members of sets in one part of a block, about, where the sets themselves are compared
_CHUNK = 1 << 20  # shingles looked at together when common ones are sought
_HOT = 1 << 20  # common shingles told apart at most
_COMMON = 16  # documents that make a shingle common at least


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; a shorter text is one, a text without words none."""
    words = space_words(text, lower=True)
    return np.unique(gram_hashes(words, min(size, len(words)))) if words else np.empty(0, np.uint64)


def _digest(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def signature(s: np.ndarray) -> np.ndarray:
    """Bit map of a set with four to eight bits for each member, at least 512; the low bits of a hash are its place."""
    bits = max(512, 4 << (len(s) - 1).bit_length())
    at = s & np.uint64(bits - 1)
    flags = np.zeros(bits, np.uint8)
    flags[at.astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").view(np.uint64)


def fold(sig: np.ndarray, width: int) -> np.ndarray:
    """The bit map at a smaller width (in 64-bit words)."""
    while sig.shape[-1] > width:
        half = sig.shape[-1] // 2
        sig = sig[..., :half] | sig[..., half:]
    return sig


class Rule:
    """Two sets link when den * intersection >= num * union, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n: int) -> int:
        """How many members of a set, in any order common to all sets, must hold one of each set it links to."""
        return n + (self.num * n // -self.den) + 1

    def sizes(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def reached(self, shared, total):
        return (self.den + self.num) * shared >= self.num * total


def among(values: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def leading(s: np.ndarray, hot: np.ndarray, rule: Rule) -> tuple[np.ndarray, bool]:
    """The members that stand for a set in the join, uncommon ones first, and whether its head alone could not tell them."""
    p = rule.prefix(len(s))
    head = s[:_head(p)]
    common = among(head, hot)
    rare, dry = head[~common], False
    if len(rare) < p and len(head) < len(s):
        head, dry = s, True
        common = among(head, hot)
        rare = head[~common]
    return (rare[:p] if len(rare) >= p else np.concatenate((rare, head[common]))[:p]), dry


def _head(p: int) -> int:
    return p + p // 4 + 4


_FIRST = "cls bigint, n int, head array<bigint>, sig binary, hot array<bigint>, times array<int>"


def _first_pass(size: int, rule: Rule, doc_type: str):
    """Set digest, size, head and bit map of each document; besides, shingles that occur in several heads of a chunk."""
    def run(frames):
        held, seen, count = [], set(), 0

        def common():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            return signed(values[times > 1]), times[times > 1].astype(np.int32)

        def out(ids, cls, n, heads, sigs, hot=None, times=None):
            return pa.RecordBatch.from_arrays(
                [ids, pa.array(cls, pa.int64()), pa.array(n, pa.int32()), pa.array(heads, pa.list_(pa.int64())), pa.array(sigs, pa.binary()),
                 pa.array(hot or [None] * len(cls), pa.list_(pa.int64())), pa.array(times or [None] * len(cls), pa.list_(pa.int32()))],
                names=["doc_id", "cls", "n", "head", "sig", "hot", "times"])

        kind = None
        for frame in frames:
            kind = frame.column(0).type
            cls, n, heads, sigs = [], [], [], []
            for text in frame.column(1):
                s = shingles(text.as_py(), size)
                n.append(len(s))
                if not len(s):
                    cls.append(None), heads.append(None), sigs.append(None)
                    continue
                head = s[:_head(rule.prefix(len(s)))]
                cls.append(_digest(s)), heads.append(signed(head)), sigs.append(signature(s).tobytes())
                if cls[-1] not in seen:
                    seen.add(cls[-1]), held.append(head)
                    count += len(head)
                if count >= _CHUNK:
                    hot, times = common()
                    yield out(pa.nulls(1, kind), [None], [None], [None], [None], [hot], [times])
                    held, seen, count = [], set(), 0
            yield out(frame.column(0), cls, n, heads, sigs)
        if held:
            hot, times = common()
            yield out(pa.nulls(1, kind), [None], [None], [None], [None], [hot], [times])
    return run


_MEMBER = "token bigint, cls bigint, n int, hot boolean, route bigint"


def _members(rows, hot):
    """Arrow rows of the leading members of sets [(digest, size, members)]."""
    token = np.concatenate([m for _, _, m in rows]) if rows else np.empty(0, np.uint64)
    times = [len(m) for _, _, m in rows]
    cls = np.repeat(np.array([c for c, _, _ in rows], np.int64), times)
    common = among(token, hot)
    route = np.where(common, mix(token ^ (cls.astype(np.uint64) & np.uint64(255))), token)
    return pa.RecordBatch.from_arrays(
        [pa.array(signed(token)), pa.array(cls), pa.array(np.repeat(np.array([n for _, n, _ in rows], np.int32), times)),
         pa.array(common), pa.array(signed(route))], names=["token", "cls", "n", "hot", "route"])


def _from_heads(rule: Rule, sent):
    """Leading members from the heads; sets that need more than their head are left to the second pass."""
    def run(frames):
        hot, seen = sent.value, set()
        for frame in frames:
            rows = []
            for cls, n, head in zip(*(frame.column(i).to_pylist() for i in (0, 1)), frame.column(2)):
                if cls in seen:
                    continue
                if len(seen) > _CHUNK:
                    seen = set()
                seen.add(cls)
                head, p = head.values.to_numpy().view(np.uint64), rule.prefix(n)
                common = among(head, hot)
                rare = head[~common]
                if len(rare) >= p:
                    rows.append((cls, n, rare[:p]))
                elif len(head) == n:
                    rows.append((cls, n, np.concatenate((rare, head[common]))[:p]))
            yield _members(rows, hot)
    return run


def _wanted(sent):
    """Batches of documents whose id's hash is in the bit map (id, text, hash of the id)."""
    def passing(frames):
        for frame in frames:
            keep = sketches.member(sent.value, frame.column(2).to_numpy().view(np.uint64))
            if keep.any():
                yield frame.filter(pa.array(keep))
    return passing


def _from_texts(size: int, rule: Rule, sent_hot, sent_ids):
    """Leading members of the sets whose head was not enough, from their texts."""
    def run(frames):
        hot = sent_hot.value
        for frame in _wanted(sent_ids)(frames):
            rows = []
            for text in frame.column(1):
                s = shingles(text.as_py(), size)
                if len(s):
                    members, dry = leading(s, hot, rule)
                    if dry:
                        rows.append((_digest(s), len(s), members))
            yield _members(rows, hot)
    return run


def _sets(size: int, sent_ids, sent_cls):
    """(cls, id_hash, members) of the wanted documents, each once in a task."""
    def run(frames):
        seen = set()
        for frame in _wanted(sent_ids)(frames):
            cls, ids, sets = [], [], []
            for text, id_hash in zip(frame.column(1), frame.column(2).to_pylist()):
                s = shingles(text.as_py(), size)
                if len(s) and (key := (_digest(s), id_hash)) not in seen:
                    seen.add(key), cls.append(key[0]), ids.append(id_hash), sets.append(s.tobytes())
            keep = pa.array(sketches.member(sent_cls.value, np.array(cls, np.int64).view(np.uint64)) if cls else [], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.filter(keep) for x in (pa.array(cls, pa.int64()), pa.array(ids, pa.int64()), pa.array(sets, pa.binary()))],
                                             names=["cls", "id_hash", "members"])
    return run


def _shared(frames):
    """Rows of shingles that lead two or more different sets; a partition holds all rows of its shingles (common ones: a share)."""
    parts = [[frame.column(i).to_numpy(zero_copy_only=False) for i in range(4)] for frame in frames if frame.num_rows]
    if not parts:
        return
    token, cls, n, hot = (np.concatenate(c) for c in zip(*parts))
    order = np.lexsort((cls, token))
    token, cls, n, hot = token[order], cls[order], n[order], hot[order]
    same = token[1:] == token[:-1]
    keep = np.append(True, ~(same & (cls[1:] == cls[:-1])))
    token, cls, n, hot = token[keep], cls[keep], n[keep], hot[keep]
    same = token[1:] == token[:-1]
    keep = hot | np.append(same, False) | np.append(False, same)
    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token, cls, n)], names=["token", "cls", "n"])


def bound(n_a, n_b, a: np.ndarray, b: np.ndarray, all_a=None, all_b=None):
    """The most members that sets below a and below b can share, from bit maps of equal width.

    A bit that every set below a has and none below b is a member of each of the former that the latter lack.
    """
    alone_a = np.bitwise_count((a if all_a is None else all_a) & ~b).sum(axis=-1, dtype=np.int64)
    alone_b = np.bitwise_count((b if all_b is None else all_b) & ~a).sum(axis=-1, dtype=np.int64)
    return np.minimum(n_a - alone_a, n_b - alone_b)


@functools.lru_cache(maxsize=LEAF + 1)
def _corner(n: int):
    return np.triu_indices(n, 1)


class Tree:
    """Leaves of rows in order of size; each node holds OR and AND of the bit maps below, the range of sizes, and the
    component that all rows below belong to, if it is one."""

    def __init__(self, n, comp, sigs):
        self.n, self.comp, self.sigs = n, comp, sigs
        self.levels = [[self._leaf(at, min(at + LEAF, len(n))) for at in range(0, len(n), LEAF)]]
        while len(self.levels[-1]) > 1:
            below = self.levels[-1]
            self.levels.append([self._node(below[at:at + FAN], range(at, min(at + FAN, len(below)))) for at in range(0, len(below), FAN)])

    def _leaf(self, start, end):
        width = min(len(s) for s in self.sigs[start:end])
        bits = np.array([fold(s, width) for s in self.sigs[start:end]])
        comps = self.comp[start:end]
        return (np.bitwise_or.reduce(bits), np.bitwise_and.reduce(bits), self.n[start:end].min(), self.n[start:end].max(),
                comps[0] if (comps == comps[0]).all() else None, range(start, end))

    @staticmethod
    def _node(kids, places):
        width = min(len(k[0]) for k in kids)
        comps = {k[4] for k in kids}
        return (np.bitwise_or.reduce([fold(k[0], width) for k in kids]), np.bitwise_and.reduce([fold(k[1], width) for k in kids]),
                min(k[2] for k in kids), max(k[3] for k in kids), comps.pop() if len(comps) == 1 else None, places)


def _may_link(a, b, rule: Rule) -> bool:
    if a[4] is not None and a[4] == b[4]:
        return False
    if rule.den * a[3] < rule.num * b[2] or rule.den * b[3] < rule.num * a[2]:
        return False
    width = min(len(a[0]), len(b[0]))
    most = bound(a[3], b[3], fold(a[0], width), fold(b[0], width), fold(a[1], width), fold(b[1], width))
    return bool(rule.reached(most, a[2] + b[2]))


def _row_pairs(i, j, n, comp, sigs, rule: Rule):
    """Those of the row pairs (i, j) whose components differ and whose sizes and bit maps leave a link possible."""
    keep = (comp[i] != comp[j]) & rule.sizes(n[i], n[j])
    i, j = i[keep], j[keep]
    if not len(i):
        return i, j
    widths = np.minimum([len(sigs[x]) for x in i], [len(sigs[x]) for x in j])
    good = np.zeros(len(i), bool)
    for width in np.unique(widths):
        at = np.flatnonzero(widths == width)
        a, b = np.array([fold(sigs[x], width) for x in i[at]]), np.array([fold(sigs[x], width) for x in j[at]])
        good[at] = rule.reached(bound(n[i[at]], n[j[at]], a, b), n[i[at]] + n[j[at]])
    return i[good], j[good]


def block_pairs(n, comp, sigs, rule: Rule, left=None):
    """Possible links in a block, or, with `left`, between its rows marked so and the others."""
    order = np.argsort(n, kind="stable")
    n, comp, sigs = n[order], comp[order], [sigs[x] for x in order]
    side = None if left is None else left[order]
    found_i, found_j = [], []

    def rows(i, j):
        if side is not None:
            keep = side[i] != side[j]
            i, j = i[keep], j[keep]
        i, j = _row_pairs(i, j, n, comp, sigs, rule)
        found_i.append(order[i]), found_j.append(order[j])

    if len(n) <= LEAF:
        rows(*_corner(len(n)))
    else:
        tree = Tree(n, comp, sigs)
        top = len(tree.levels) - 1
        stack = [(top, 0, 0)]
        while stack:
            level, x, y = stack.pop()
            a, b = tree.levels[level][x], tree.levels[level][y]
            if not _may_link(a, b, rule):
                continue
            if level == 0:
                i, j = np.meshgrid(np.array(a[5]), np.array(b[5]), indexing="ij")
                i, j = i.ravel(), j.ravel()
                keep = i < j
                rows(i[keep], j[keep])
            else:
                stack += [(level - 1, u, v) for u in a[5] for v in b[5] if u <= v]
    return np.concatenate(found_i) if found_i else np.empty(0, int), np.concatenate(found_j) if found_j else np.empty(0, int)


def _in_blocks(frames, names):
    """(block, rows) of Arrow rows sorted by (block, part, other), with the columns `names` of each row, a set's digest first.

    A set that comes twice, as that of a repeated document, is in the block once.
    """
    block, rows, seen = None, [], set()
    for frame in frames:
        for key, row in zip(zip(*(frame.column(c).to_pylist() for c in ("block", "part", "other"))), zip(*(frame.column(c).to_pylist() for c in names))):
            if key != block:
                if len(rows) > 1:
                    yield block, rows
                block, rows, seen = key, [], set()
            if row[0] not in seen:
                seen.add(row[0]), rows.append(row)
    if len(rows) > 1:
        yield block, rows


def _own_pairs(block, comp, n, sigs, side, leaders, rule: Rule):
    """Possible links between components of a block, without those that a block with a smaller leader has too."""
    left = None if block[1] == block[2] else np.array(side, bool)
    i, j = block_pairs(np.array(n, np.int64), np.array(comp, np.int64), sigs, rule, left)
    led = [set(x) for x in leaders]
    own = np.fromiter((min(led[x] & led[y]) == block[0] for x, y in zip(i, j)), bool, len(i))
    return i[own], j[own]


_INVOLVED = "block bigint, part int, other int, cls bigint, comp bigint, side boolean, leaders array<bigint>"


def _involved(rule: Rule):
    """The rows of each block that bit maps leave a link possible for."""
    def run(frames):
        for block, rows in _in_blocks(frames, ("cls", "comp", "n", "sig", "side", "leaders")):
            cls, comp, n, sigs, side, leaders = zip(*rows)
            ends = np.unique(np.concatenate(_own_pairs(block, comp, n, [np.frombuffer(x, np.uint64) for x in sigs], side, leaders, rule)))
            if len(ends):
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array([block[k]] * len(ends), t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()))), pa.array([cls[x] for x in ends], pa.int64()),
                     pa.array([comp[x] for x in ends], pa.int64()), pa.array([side[x] for x in ends], pa.bool_()), pa.array([leaders[x] for x in ends], pa.list_(pa.int64()))],
                    names=["block", "part", "other", "cls", "comp", "side", "leaders"])
    return run


def shared_members(i, j, sets):
    """How many members the sets of each pair (i, j) share; i comes in order."""
    sizes = np.array([len(x) for x in sets])
    ends = np.cumsum(sizes)
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    rows = [ids[e - k:e] for e, k in zip(ends, sizes)]
    mark, out = np.zeros(len(ids), bool), np.empty(len(i), np.int64)
    cuts = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for start, stop in zip(cuts, [*cuts[1:], len(i)]):
        mark[rows[i[start]]] = True
        for at in range(start, stop, LEAF * FAN):
            others = j[at:min(at + LEAF * FAN, stop)]
            out[at:at + len(others)] = np.add.reduceat(mark[np.concatenate([rows[x] for x in others])].astype(np.int64), np.append(0, np.cumsum(sizes[others])[:-1]))
        mark[rows[i[start]]] = False
    return out


def _all_links(rule: Rule):
    """All links of each block, and whether a link joins what the links before it in the block left apart."""
    def run(frames):
        for block, rows in _in_blocks(frames, ("cls", "members", "side", "leaders")):
            cls, members, side, leaders = zip(*rows)
            sets = [np.frombuffer(x, np.uint64) for x in members]
            n = np.array([len(x) for x in sets])
            i, j = _own_pairs(block, cls, n, [signature(x) for x in sets], side, leaders, rule)  # every set is its own component
            if not len(i):
                continue
            order = np.argsort(i, kind="stable")
            i, j = i[order], j[order]
            linked = rule.reached(shared_members(i, j, sets), n[i] + n[j])
            i, j = i[linked], j[linked]
            root = list(range(len(cls)))

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            joins = np.zeros(len(i), bool)
            for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
                x, y = top(x), top(y)
                joins[k] = x != y
                root[x] = y
            cls = np.array(cls, np.int64)
            for at in range(0, len(i), 1 << 16):
                x, y = cls[i[at:at + (1 << 16)]], cls[j[at:at + (1 << 16)]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(joins[at:at + (1 << 16)])], names=["a", "b", "joins"])
    return run


def _joining_links(rule: Rule):
    """Links of each block that join components; what the links before it in the block connect is not compared again."""
    def run(frames):
        for block, rows in _in_blocks(frames, ("cls", "comp", "members", "side", "leaders")):
            cls, comp, members, side, leaders = zip(*rows)
            sets = [np.frombuffer(x, np.uint64) for x in members]
            n = np.array([len(x) for x in sets])
            i, j = _own_pairs(block, comp, n, [signature(x) for x in sets], side, leaders, rule)
            root, out = {x: x for x in comp}, []

            def top(x):
                while root[x] != x:
                    root[x] = x = root[root[x]]
                return x

            order = np.argsort(i, kind="stable")
            for x, y in zip(i[order].tolist(), j[order].tolist()):
                a, b = top(comp[x]), top(comp[y])
                if a == b:
                    continue
                short, long = sorted((sets[x], sets[y]), key=len)
                if rule.reached(int(among(short, long).sum()), len(short) + len(long)):
                    root[a] = b
                    out.append((cls[x], cls[y]))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    return run


def _bounded(rule: Rule):
    """Pairs whose bit maps leave a link possible."""
    def run(frames):
        for frame in frames:
            a, b, n_a, n_b, sig_a, sig_b = (frame.column(c).to_pylist() for c in ("a", "b", "n_a", "n_b", "sig_a", "sig_b"))
            sigs = [np.frombuffer(s, np.uint64) for s in (*sig_a, *sig_b)]
            i, _ = _row_pairs(np.arange(len(a)), np.arange(len(a)) + len(a), np.array(n_a + n_b, np.int64), np.array(a + b, np.int64), sigs, rule)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in i], pa.int64()) for x in (a, b)], names=["a", "b"])
    return run


def _with_leader(rule: Rule):
    """Links of leaders: rows come sorted by (leader, part), the leader's own set first; a set travels once for each leader."""
    def run(frames):
        group, leader = None, None
        for frame in frames:
            a, part, b = (frame.column(c).to_pylist() for c in ("a", "part", "b"))
            good = []
            for k, members in enumerate(frame.column("members")):
                members = np.frombuffer(members.as_buffer(), np.uint64)
                if a[k] == b[k]:
                    group, leader = (a[k], part[k]), members.copy()
                elif (a[k], part[k]) == group:
                    short, long = sorted((leader, members), key=len)
                    if rule.reached(int(among(short, long).sum()), len(leader) + len(members)):
                        good.append(k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in good], pa.int64()) for x in (a, b)], names=["a", "b"])
    return run


def link_classes(docs: DataFrame, size: int, num: int, den: int, every_link: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, classes, links): rows (doc_id, cls, n) of all documents, (cls, rep, n) of all distinct non-empty sets,
    and links (a, b) between classes that, with equal sets, connect the same documents as all links do.

    With `every_link` these are all links, each once as (a, b, joins); those that have `joins` connect the same as all.
    """
    spark, rule = docs.sparkSession, Rule(num, den)
    send = spark.sparkContext.broadcast
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id").alias("id_hash"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = stage(docs.select("doc_id", "text").mapInArrow(_first_pass(size, rule, kind), f"doc_id {kind}, {_FIRST}"))
    sets = first.where("cls is not null")
    total = sets.agg(F.sum(F.size("head"))).first()[0] or 0
    hot = (first.where("hot is not null").select(F.explode(F.arrays_zip("hot", "times")).alias("x")).groupBy("x.hot").agg(F.sum("x.times").alias("t"))
           .where(F.col("t") > F.lit(max(_COMMON, total // _HOT))).select("hot").toArrow().column(0).to_numpy().view(np.uint64))
    sent_hot = send(np.sort(hot))
    classes = stage(sets.groupBy("cls").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("sig").alias("sig")))

    members = sets.select("cls", "n", "head").mapInArrow(_from_heads(rule, sent_hot), _MEMBER)
    if len(hot):
        dry = sketches_of_dry(sets, sent_hot, rule)
        members = members.union(docs.mapInArrow(_from_texts(size, rule, sent_hot, send(sketches.bitmap(dry, "id_hash"))), _MEMBER))
    shared = stage(members.repartition("route").select("token", "cls", "n", "hot").mapInArrow(_shared, "token bigint, cls bigint, n int"))

    def possible(pairs: DataFrame) -> DataFrame:
        side = lambda x: classes.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))
        return stage(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_bounded(rule), "a bigint, b bigint"))

    def of_rep(rows: DataFrame) -> DataFrame:
        """Rows with a column cls, and the hashed id of the document that gives its set."""
        return stage(rows.join(classes.select("cls", F.xxhash64("rep").alias("id_hash")), "cls"))

    def with_sets(rows: DataFrame) -> DataFrame:
        """Rows of `of_rep` with their sets, which cross the network for this join alone: copies other than the class's own
        document meet no row, and only where that document is repeated a row may come twice."""
        wanted = [send(sketches.bitmap(rows, c)) for c in ("id_hash", "cls")]
        return rows.join(docs.mapInArrow(_sets(size, *wanted), "cls bigint, id_hash bigint, members binary"), ["cls", "id_hash"])

    held = F.greatest(F.count("*") / PART, F.sum(F.col("n").cast("long")) / MEMBERS)  # parts of a block, by rows and by members

    def with_leaders(pairs: DataFrame) -> DataFrame:
        """Links among pairs (a, b): each b's set goes to its leader a, in parts of bounded size that each hold a's set."""
        parts = pairs.join(classes.select(F.col("cls").alias("b"), "n"), "b").groupBy("a").agg(F.ceil(held).cast("int").alias("parts"))
        rows = of_rep(pairs.join(parts, "a").select("a", F.col("b").alias("cls"), F.pmod(F.xxhash64("b"), "parts").cast("int").alias("part"))
                      .union(parts.select("a", F.col("a").alias("cls"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))))
        linked = stage(with_sets(rows).withColumnRenamed("cls", "b").repartition("a", "part").sortWithinPartitions("a", "part", F.col("a") != F.col("b"))
                       .mapInArrow(_with_leader(rule), "a bigint, b bigint"))
        release(rows, pairs)
        return linked

    # The leader of a block: the set with the fewest leading members of its own, as the original of edited copies is.
    leading_members = F.col("n") - F.ceil(F.col("n").cast("long") * num / den) + 1
    alone = stage(shared.groupBy("cls").agg((F.min(leading_members) - F.count("*")).cast("long").alias("alone")))
    ranked = stage(shared.join(alone, "cls").select("token", "cls", F.struct("alone", "cls").alias("rank")))
    leaders = stage(ranked.groupBy("token").agg(F.min("rank").alias("first"), F.max("rank").alias("last")).where("first <> last")
                    .select("token", F.col("first.cls").alias("a")))
    # All blocks of one leader are one block: (a, b) for each set b that shares a leading member of a block led by a.
    blocks = stage(ranked.join(leaders, "token").select("a", F.col("cls").alias("b")).distinct())
    release(shared, alone, ranked, leaders)

    def dealt(rows: DataFrame, parts: DataFrame) -> DataFrame:
        """The rows (a, cls, …) of the blocks in `parts` (a, parts), each once for every part it is compared with."""
        rows = stage(rows.join(parts, "a"))
        led = rows.groupBy("cls").agg(F.collect_set("a").alias("leaders"))
        mine = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("cls"), F.col("parts"))).otherwise(0).cast("int")
        return (rows.join(led, "cls").join(classes.select("cls", "n", "sig"), "cls").withColumn("mine", mine)
                .withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                .withColumns({"block": F.col("a"), "part": F.least("mine", "theirs"), "other": F.greatest("mine", "theirs"), "side": F.col("mine") < F.col("theirs")}))

    def by_block(rows: DataFrame) -> DataFrame:
        return rows.repartition("block", "part", "other").sortWithinPartitions("block", "part", "other")

    if every_link:
        rows = blocks.select("a", F.col("b").alias("cls"))
        parts = (rows.join(classes.select("cls", "n"), "cls").groupBy("a").agg(F.count("*").alias("rows"), F.ceil(held).cast("int").alias("parts"))
                 .where("rows > 1").select("a", "parts"))
        rows = by_block(dealt(rows, parts).select("block", "part", "other", "cls", F.col("cls").alias("comp"), "n", "sig", "side", "leaders"))
        rows = of_rep(rows.mapInArrow(_involved(rule), _INVOLVED))
        links = stage(by_block(with_sets(rows)).mapInArrow(_all_links(rule), "a bigint, b bigint, joins boolean"))
        return first.where("hot is null").select("doc_id", "cls", "n"), classes.select("cls", "rep", "n"), links

    links = with_leaders(possible(blocks.where("a <> b")))
    labels = components(links)

    named = stage(blocks.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", F.col("b").alias("cls"), F.coalesce("label", "b").alias("comp")))
    parts = stage(named.join(classes.select("cls", "n"), "cls").groupBy("a").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.ceil(held).cast("int").alias("parts"))
                  .where("lo <> hi").select("a", "parts"))
    rows = by_block(dealt(named, parts).select("block", "part", "other", "cls", "comp", "n", "sig", "side", "leaders"))
    rows = of_rep(rows.mapInArrow(_involved(rule), _INVOLVED))
    more = stage(by_block(with_sets(rows)).mapInArrow(_joining_links(rule), "a bigint, b bigint"))
    release(rows, named, blocks)
    return first.where("hot is null").select("doc_id", "cls", "n"), classes.select("cls", "rep", "n"), links.union(more)


def sketches_of_dry(sets: DataFrame, sent_hot, rule: Rule) -> DataFrame:
    """Hashed ids of the documents whose head holds too few uncommon shingles."""
    def run(frames):
        hot = sent_hot.value
        for frame in frames:
            keep = []
            for n, head in zip(frame.column(1).to_pylist(), frame.column(2)):
                head = head.values.to_numpy().view(np.uint64)
                keep.append(len(head) < n and len(head) - among(head, hot).sum() < rule.prefix(n))
            yield pa.RecordBatch.from_arrays([frame.column(0).filter(pa.array(keep, pa.bool_()))], names=["id_hash"])

    return sets.select(F.xxhash64("doc_id").alias("id_hash"), "n", "head").mapInArrow(run, "id_hash bigint")


def jaccard_components(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, every_link: bool = True) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, class_id, n_copies, n_links), one for each row of `docs` (doc_id, text).

    Two documents link when den * |A & B| >= num * |A | B| over the sets of their distinct word shingles of `size` words (A-Z as
    a-z; a text with fewer words is one shingle).  component_id is the smallest doc_id reachable over links, itself included;
    class_id the smallest doc_id with an equal set, n_copies how many rows have it, n_links how many other classes the class
    links to.  Without `every_link` the column n_links is left out, and a class already connected is not compared again.

    Documents without words (null text included) link with nothing: component_id and class_id are their own doc_id.  Repeated
    rows are copies of one another; null doc_ids lose against any other; an empty table gives no rows; other columns are
    ignored.  Sets are told apart by 64-bit digests of 64-bit shingle hashes.

    Each set stands in the join with the few shingles of which every set it links to must share one, uncommon shingles first;
    copies stand once.  Sets that share such a shingle form a block with a leader, the one with the fewest shingles that no other
    set has, and all blocks of one leader are one.  The sets of a block are put in a tree whose nodes hold OR- and AND-combined
    bit maps and size ranges, and pairs of nodes that cannot reach the overlap are pruned; the sets of the rest come to the
    block and are compared there.  For the components alone, all sets of a block are compared with its leader first, and only what
    is not yet in one component by the tree.  Blocks over `PART` rows (or `MEMBERS` members) are cut, and the parts are
    compared two by two, so no task holds an unbounded block.
    """
    rows, classes, links = link_classes(docs, size, num, den, every_link)
    labels = components(links.where("joins") if every_link else links)
    counted = links.select("a", "b").union(links.select("b", "a")).distinct().groupBy("a").agg(F.count("*").alias("n_links"))
    named = stage(classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").join(counted.withColumnRenamed("a", "cls"), "cls", "left")
                  .select("cls", "rep", F.coalesce("label", "cls").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links")))
    least = stage(named.groupBy("label").agg(F.min("rep").alias("component")))
    sizes = rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n_copies"))
    known = stage(named.join(least, "label").join(sizes, "cls").select("cls", "rep", "component", "n_links", "n_copies"))
    return rows.join(known, "cls", "left").select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if every_link else []))


def keep_representatives(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Of each component of near-duplicates the rows of its smallest doc_id (of repeated rows one); all columns stay.

    Documents without words stay.  Rows that share the smallest doc_id but not the text stay each if their texts differ.
    """
    found = jaccard_components(docs, size, num, den, every_link=False).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("doc_id").distinct()
    free = next(name for k in range(len(docs.columns) + 1) if (name := f"kept{k}") not in map(str.lower, docs.columns))
    kept = docs.join(found.withColumnRenamed("doc_id", free), F.col("doc_id").eqNullSafe(F.col(free)), "left_semi")
    if docs.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates(["doc_id", "text"])
