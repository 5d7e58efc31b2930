"""Evolutionary distances of all pairs of aligned sequences.

Each sequence becomes one bit mask a base (60 sites a word), so the joint counts of the bases of a pair are popcounts
of intersections, and the models are closed forms over the 16 counts. Pairs are made by blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sylva.operators.pairs import block_pairs, ends_of, flat, pairs_below, tiles
from sylva.operators.tree_tables import settled

WORD = 60
#: Words of a sequence that become columns of the pairs.
MOST_WORDS = 4
#: Blocks of each side of the pairs of sequences, whose rows are small and whose pairs are many.
PAIR_BLOCKS = 12
BASES = "acgt"
MODELS = ("raw", "n", "ts", "tv", "jc69", "k80", "f81", "k81", "f84", "t92", "tn93", "logdet", "bh87", "paralin", "indel")
_NEED_FREQ = {"f81", "f84", "t92", "tn93"}


def _mask(seq: Column, base: str) -> Column:
    """Words of bits, one a site, set where the site has the base."""
    others = "".join(c for c in BASES if c != base)
    bits = F.regexp_replace(F.regexp_replace(F.translate(seq, others, "0" * len(others)), f"[^{base}0]", "0"), base, "1")
    words = F.sequence(F.lit(0), F.floor((F.length(seq) - 1) / WORD).cast("int"))
    return F.transform(words, lambda w: F.conv(F.substring(bits, w * WORD + 1, F.lit(WORD)), 2, 10).cast("long"))


def masks(seqs: DataFrame, pairwise_deletion: bool = False) -> DataFrame:
    """(label, m_a, m_c, m_g, m_t); without pairwise deletion only sites known in all sequences count."""
    s = seqs.select("label", F.lower("seq").alias("seq"))
    out = s.select("label", *[_mask(F.col("seq"), b).alias(f"m_{b}") for b in BASES])
    if pairwise_deletion:
        return out
    known = F.transform(F.arrays_zip(*[f"m_{b}" for b in BASES]), lambda x: x["m_a"].bitwiseOR(x["m_c"]).bitwiseOR(x["m_g"]).bitwiseOR(x["m_t"]))
    every = out.select(F.posexplode(known).alias("w", "k")).groupBy("w").agg(F.bit_and("k").alias("k")).agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "k"))), lambda x: x["k"]).alias("every"))
    both = out.crossJoin(F.broadcast(every))
    return both.select("label", *[F.zip_with(f"m_{b}", "every", lambda x, k: x.bitwiseAND(k)).alias(f"m_{b}") for b in BASES])


def joint_counts(seqs: DataFrame, pairwise_deletion: bool = False) -> DataFrame:
    """(i, j, f_aa, f_ac, ... f_tt) for all pairs of labels i < j.

    Up to ``MOST_WORDS`` words the masks become plain columns, so a pair costs 16 intersections a word of generated code; functions on
    arrays, which are interpreted, take longer sequences.
    """
    m = masks(seqs, pairwise_deletion)
    sizes = seqs.agg(F.max(F.length("seq"))).first()[0] or 1
    n = -(-sizes // WORD)
    if n > MOST_WORDS:
        a, b = (m.select(F.col("label").alias(key), *[F.col(f"m_{x}").alias(f"{key}_{x}") for x in BASES]) for key in "ij")

        def both(x: str, y: str) -> Column:
            words = F.zip_with(f"i_{x}", f"j_{y}", lambda p, q: F.bit_count(p.bitwiseAND(q)))
            return F.aggregate(words, F.lit(0), lambda s, v: s + v).cast("long").alias(f"f_{x}{y}")

    else:  # a word that a shorter sequence does not have is 0, as it has no base there
        a, b = (m.select(F.col("label").alias(key), *[F.coalesce(F.get(f"m_{x}", F.lit(w)), F.lit(0).cast("long")).alias(f"{key}_{x}{w}") for x in BASES for w in range(n)]) for key in "ij")

        def both(x: str, y: str) -> Column:
            return F.expr(" + ".join(f"bit_count(i_{x}{w} & j_{y}{w})" for w in range(n))).cast("long").alias(f"f_{x}{y}")

    counts = F.array(F.struct(*[both(x, y) for x in BASES for y in BASES]))
    # one row of a generator, so that the optimiser does not write each count out wherever a model's formula has it
    return pairs_below(a, b, "i", "j", PAIR_BLOCKS).select("i", "j", F.inline(counts))


def _ln(x: str) -> str:
    return f"CASE WHEN ({x}) > 0 THEN ln({x}) END"


def _det(f: list[list[str]]) -> str:
    """Determinant of a 4 x 4 matrix of SQL expressions, by its first row."""

    def det3(m):
        (a, b, c), (d, e, g), (h, i, k) = m
        return f"({a} * ({e} * {k} - {g} * {i}) - {b} * ({d} * {k} - {g} * {h}) + {c} * ({d} * {i} - {e} * {h}))"

    out = []
    for col in range(4):
        minor = [[row[c] for c in range(4) if c != col] for row in f[1:]]
        out.append(f"{'-' if col % 2 else '+'} {f[0][col]} * {det3(minor)}")
    return "(" + " ".join(out).lstrip("+ ") + ")"


#: Counts over the joint table, as SQL: sites, differences, transitions by kind, transversions by kind.
COUNTS = {
    "L": " + ".join(f"f_{x}{y}" for x in BASES for y in BASES),
    "Nd": " + ".join(f"f_{x}{y}" for x in BASES for y in BASES if x != y),
    "Ns1": "f_ag + f_ga",
    "Ns2": "f_ct + f_tc",
    "Nv1": "f_at + f_ta + f_cg + f_gc",
    "Nv2": "f_ac + f_ca + f_gt + f_tg",
}


def formula(model: str, gamma: float | None = None) -> str:
    """SQL for a distance over L, Nd, Ns1, Ns2, Nv1, Nv2 (doubles), the joint counts and base frequencies pa, pc, pg, pt."""
    p, s, q = "(Nd / L)", "((Ns1 + Ns2) / L)", "((Nd - Ns1 - Ns2) / L)"
    if model == "raw":
        return p
    if model == "n":
        return "Nd"
    if model == "ts":
        return "Ns1 + Ns2"
    if model == "tv":
        return "Nd - Ns1 - Ns2"
    if model == "jc69":
        x = f"1 - 4 * {p} / 3"
        return f"0.75 * {gamma} * (CASE WHEN ({x}) > 0 THEN pow({x}, {-1 / gamma}) END - 1)" if gamma else f"-0.75 * {_ln(x)}"
    if model == "k80":
        a1, a2 = f"1 - 2 * {s} - {q}", f"1 - 2 * {q}"
        if gamma:
            power = lambda x: f"CASE WHEN ({x}) > 0 THEN pow({x}, {-1 / gamma}) END"
            return f"{gamma} / 2 * ({power(a1)} + 0.5 * {power(a2)} - 1.5)"
        return f"-0.5 * ({_ln(a1)}) - 0.25 * ({_ln(a2)})"
    if model == "f81":
        e = "(1 - pa * pa - pc * pc - pg * pg - pt * pt)"
        x = f"1 - {p} / {e}"
        return f"{e} * {gamma} * (CASE WHEN ({x}) > 0 THEN pow({x}, {-1 / gamma}) END - 1)" if gamma else f"-{e} * ({_ln(x)})"
    if model == "k81":
        pp, qq, rr = "((Nd - Nv1 - Nv2) / L)", "(Nv1 / L)", "(Nv2 / L)"
        a = [f"1 - 2 * {pp} - 2 * {qq}", f"1 - 2 * {pp} - 2 * {rr}", f"1 - 2 * {qq} - 2 * {rr}"]
        return "-0.25 * (" + " + ".join(f"({_ln(x)})" for x in a) + ")"
    if model == "f84":
        a = "(pa * pg / (pa + pg) + pc * pt / (pc + pt))"
        b = "(pa * pg + pc * pt)"
        c = "((pa + pg) * (pc + pt))"
        return f"-2 * {a} * ({_ln(f'1 - {s} / (2 * {a}) - ({a} - {b}) * {q} / (2 * {a} * {c})')}) + 2 * ({a} - {b} - {c}) * ({_ln(f'1 - {q} / (2 * {c})')})"
    if model == "t92":
        w = "(2 * (pc + pg) * (1 - pc - pg))"
        return f"-{w} * ({_ln(f'1 - {s} / {w} - {q}')}) - 0.5 * (1 - {w}) * ({_ln(f'1 - 2 * {q}')})"
    if model == "tn93":
        r, y = "(pa + pg)", "(pc + pt)"
        k1, k2 = f"(2 * pa * pg / {r})", f"(2 * pc * pt / {y})"
        k3 = f"(2 * ({r} * {y} - pa * pg * {y} / {r} - pc * pt * {r} / {y}))"
        w1 = f"1 - (Ns1 / L) / {k1} - {q} / (2 * {r})"
        w2 = f"1 - (Ns2 / L) / {k2} - {q} / (2 * {y})"
        w3 = f"1 - {q} / (2 * {r} * {y})"
        if gamma:
            power = lambda x: f"CASE WHEN ({x}) > 0 THEN pow({x}, {-1 / gamma}) END"
            k4 = f"(2 * ({r} * {y} + pa * pg + pc * pt) - 2 * ({r} * {y}))"
            return f"{gamma} * ({k1} * {power(w1)} + {k2} * {power(w2)} + {k3} * {power(w3)} - {k1} - {k2} - {k3}) + 0 * {k4}"
        return f"-{k1} * ({_ln(w1)}) - {k2} * ({_ln(w2)}) - {k3} * ({_ln(w3)})"
    f = [[f"(f_{x}{y} / L)" for y in BASES] for x in BASES]
    if model == "logdet":
        return f"({_ln(_det(f))}) / -4 - ln(4)"
    rows = {x: "(" + " + ".join(f"f_{x}{y}" for y in BASES) + ")" for x in BASES}
    cols = {y: "(" + " + ".join(f"f_{x}{y}" for x in BASES) + ")" for y in BASES}
    if model == "bh87":  # from i to j: each row of the joint table sums to 1
        g = [[f"(1e0 * f_{x}{y} / nullif({rows[x]}, 0))" for y in BASES] for x in BASES]
        return f"({_ln(_det(g))}) / -4"
    if model == "bh87_back":
        g = [[f"(1e0 * f_{x}{y} / nullif({cols[y]}, 0))" for x in BASES] for y in BASES]
        return f"({_ln(_det(g))}) / -4"
    if model == "paralin":
        total = " * ".join(f"({rows[x]} / L) * ({cols[x]} / L)" for x in BASES)
        return f"({_ln(f'{_det(f)} / nullif(sqrt({total}), 0)')}) / -4"
    raise ValueError(f"no model {model!r}")


def variance(model: str) -> str:
    """SQL for the sampling variance of the simple models."""
    p, s, q = "(Nd / L)", "((Ns1 + Ns2) / L)", "((Nd - Ns1 - Ns2) / L)"
    if model == "raw":
        return f"{p} * (1 - {p}) / L"
    if model == "jc69":
        return f"{p} * (1 - {p}) / nullif(pow(1 - 4 * {p} / 3, 2) * L, 0)"
    if model == "k80":
        c1, c2 = f"(1 / nullif(1 - 2 * {s} - {q}, 0))", f"(1 / nullif(1 - 2 * {q}, 0))"
        c3 = f"(({c1} + {c2}) / 2)"
        return f"({c1} * {c1} * {s} + {c3} * {c3} * {q} - pow({c1} * {s} + {c3} * {q}, 2)) / L"
    if model == "f81":
        e = "(1 - pa * pa - pc * pc - pg * pg - pt * pt)"
        return f"{p} * (1 - {p}) / nullif(pow(1 - {p} / {e}, 2) * L, 0)"
    raise ValueError(f"no variance for {model!r}")


#: Combinations of counts of which a model's values are computed once, and looked up by the pairs.
MOST_COMBINATIONS = 1 << 20
#: The bases whose joint occurrences each count adds up.
_CELLS = {
    "L": [(x, y) for x in BASES for y in BASES],
    "Nd": [(x, y) for x in BASES for y in BASES if x != y],
    "Ns1": [("a", "g"), ("g", "a")],
    "Ns2": [("c", "t"), ("t", "c")],
    "Nv1": [("a", "t"), ("t", "a"), ("c", "g"), ("g", "c")],
    "Nv2": [("a", "c"), ("c", "a"), ("g", "t"), ("t", "g")],
} | {f"f_{x}{y}": [(x, y)] for x in BASES for y in BASES}


def _words(table: pa.Table) -> dict[str, np.ndarray]:
    """The masks of a block, one row a word, in the narrowest type."""
    out = {}
    for x in BASES:
        lists = table[f"m_{x}"].combine_chunks()
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        most = int(lengths.max(initial=0))
        words = np.zeros((len(lengths), most), np.uint64)
        words[np.arange(most) < lengths[:, None]] = lists.flatten().to_numpy(zero_copy_only=False).astype(np.uint64)
        out[x] = np.ascontiguousarray(words.T)
    return {x: w.astype(np.uint32) for x, w in out.items()} if all(w.max(initial=0) < 1 << 32 for w in out.values()) else out


#: Pairs that are counted at once, few enough that their bits stay in a core's cache.
AT_ONCE = 1 << 15


class _Counter:
    """Counts of all pairs of some rows of one block and a whole other one, in memory that is used again for the next rows.

    No site has two cells of a count, so these share a popcount.
    """

    def __init__(self, a: dict, b: dict, names: list[str]):
        self.a, self.words, self.m = a, min(len(a["a"]), len(b["a"])), b["a"].shape[1]
        self.step = max(1, AT_ONCE // max(1, self.m))
        kind = np.result_type(a["a"], b["a"])
        self.bits, self.met = np.empty((2, self.step, self.m), kind)
        self.ones = np.empty((self.step, self.m), np.uint8)
        self.terms = {}  # of each count and word: the masks of the first block and those that they meet in the second
        for name in names:
            ys = {x: [q for p, q in _CELLS[name] if p == x] for x in BASES}
            sides: dict[tuple, list] = {}
            for x in BASES:
                if ys[x]:
                    sides.setdefault(tuple(ys[x]), []).append(x)
            self.terms[name] = [[tuple(np.bitwise_or.reduce([side[k][w] for k in keys]) for side, keys in ((a, xs), (b, y))) for y, xs in sides.items()] for w in range(self.words)]

    def add(self, name: str, rows: slice, out: np.ndarray) -> None:
        """Adds the count of the pairs of at most ``step`` rows to ``out``."""
        n = rows.stop - rows.start
        bits, met, ones = self.bits[:n], self.met[:n], self.ones[:n]
        for terms in self.terms[name]:
            for k, (x, y) in enumerate(terms):
                np.bitwise_and(x[rows, None], y[None, :], out=met if k else bits)
                if k:
                    np.bitwise_or(bits, met, out=bits)
            np.add(out, np.bitwise_count(bits, out=ones), out=out, casting="unsafe")

    def parts(self, rows: slice):
        """The rows of a tile by at most ``step``, and their places in it."""
        for at in range(rows.start, rows.stop, self.step):
            part = slice(at, min(at + self.step, rows.stop))
            yield part, slice(at - rows.start, part.stop - rows.start)

    def counted(self, name: str, rows: slice, kind: type) -> np.ndarray:
        out = np.zeros((rows.stop - rows.start, self.m), kind)
        for part, at in self.parts(rows):
            self.add(name, part, out[at])
        return out


def _bits(words: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The masks of a block as zeros and ones: one row a sequence, one column a site."""
    return {x: np.unpackbits(np.ascontiguousarray(w.T, "<u8").view(np.uint8), axis=1, bitorder="little") for x, w in words.items()}


def _coded(names: list[str], sites: int) -> Callable:
    """Of two blocks: a function from rows of the first to the codes of their pairs, the counts as digits to base sites + 1.

    A code is a sum over the sites of a weight of the two bases, so those of a tile are one product of matrices. Codes and all partial sums are
    whole numbers below ``MOST_COMBINATIONS``, which single precision holds exactly in any order of the additions.
    """
    weights = {(x, y): sum((sites + 1) ** k for k, c in enumerate(reversed(names)) if (x, y) in _CELLS[c]) for x in BASES for y in BASES}
    nowhere = np.empty(0, int)

    def of(a: dict, b: dict) -> Callable:
        a, b = _bits(a), _bits(b)
        n = min(a["a"].shape[1], b["a"].shape[1])
        known = np.logical_and(*(np.bitwise_or.reduce([side[x][:, :n] for x in BASES]).any(0) for side in (a, b)))
        left = np.concatenate([a[x][:, :n][:, known] for x in BASES], 1).astype(np.float32)
        right = np.concatenate([sum(np.float32(weights[x, y]) * b[y][:, :n][:, known].T for y in BASES) for x in BASES])
        sums, codes = (np.empty((0, right.shape[1]), kind) for kind in (np.float32, np.intp))

        def coded(rows: slice) -> tuple:
            nonlocal sums, codes
            m = rows.stop - rows.start
            if m > len(sums):
                sums, codes = (np.empty((m, right.shape[1]), kind) for kind in (np.float32, np.intp))
            np.matmul(left[rows], right, out=sums[:m])
            np.copyto(codes[:m], sums[:m], casting="unsafe")
            return codes[:m], nowhere, nowhere

        return coded

    return of


def pair_counts(seqs: DataFrame, names: list[str], pairwise_deletion: bool = False, sites: int | None = None) -> DataFrame:
    """(i, j, and the counts of ``names``) for all pairs of labels i < j, by blocks in array code; ``sites``: the longest sequence."""
    kind = np.int8 if sites is not None and sites < 128 else np.int32

    def kernel(a, b, tiles):
        counter, keys = _Counter(_words(a), _words(b), names), ends_of(a["label"], b["label"])
        for tile in tiles:
            yield [*keys(tile), *[flat(counter.counted(c, tile[0], kind), tile) for c in names]]

    label = seqs.schema["label"].dataType.simpleString()
    columns = [f"{c} {'tinyint' if kind is np.int8 else 'int'}" for c in names]
    return block_pairs(masks(seqs, pairwise_deletion), "label", kernel, ", ".join([f"i {label}", f"j {label}", *columns]))


def pair_values(seqs: DataFrame, names: list[str], pairwise_deletion: bool, values: np.ndarray, unit: int, coded: Callable) -> DataFrame:
    """(i, j, d) for all pairs of labels i < j that share a known site, by blocks in array code: d is looked up in ``values``, NaN for null.

    ``coded(a, b)``, of the masks of two blocks, gives a function from rows of the first to the places in ``values`` of their pairs, at least
    ``unit`` for each site known in both, and the pairs that have another value, with that. The blocks of a pair are brought together as one
    row, and a second pass makes its pairs batch by batch, so that no task holds them and their rows are read while the next ones are made.
    What leaves Python is one row a sequence and block, with the values of its pairs side by side; generated code makes these into rows.
    """
    values = values.copy()
    values[:unit] = -np.inf  # no site known in both: not a pair

    def packed(a, b, _):
        sides = []
        for side in (a, b):
            words = _words(side)
            label = side["label"].combine_chunks()
            masks_of = np.array([words[x] for x in BASES], np.uint64).tobytes()
            sides += [pa.ListArray.from_arrays(pa.array([0, len(label)], pa.int32()), label), pa.array([masks_of], pa.binary())]
        yield sides

    def words_of(raw: bytes, n: int) -> dict[str, np.ndarray]:
        words = np.frombuffer(raw, np.uint64).reshape(len(BASES), -1, n)
        return dict(zip(BASES, words if words.max(initial=0) >= 1 << 32 else words.astype(np.uint32)))

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                i, j = (batch[c][k].values for c in ("i", "j"))
                codes, repeated = coded(words_of(batch["x"][k].as_py(), len(i)), words_of(batch["y"][k].as_py(), len(j))), {}
                for rows, kept in tiles(pa.chunked_array([i]), pa.chunked_array([j]), i.equals(j)):
                    code, places, other = codes(rows)
                    found = values.take(code, mode="clip").ravel()
                    found[places] = other
                    if kept is not None:
                        found, all_found = np.full(found.shape, -np.inf), found
                        found[kept] = all_found[kept]
                    m = rows.stop - rows.start
                    ends = pa.array(np.arange(m + 1, dtype=np.int32) * len(j))
                    if m not in repeated:
                        repeated[m] = pa.ListArray.from_arrays(ends, j.take(pa.array(np.tile(np.arange(len(j)), m))))
                    yield pa.RecordBatch.from_arrays([i[rows.start : rows.stop], repeated[m], pa.ListArray.from_arrays(ends, pa.array(found))], names=["i", "js", "ds"])

    label = seqs.schema["label"].dataType
    kind = label.simpleString()
    met = block_pairs(masks(seqs, pairwise_deletion), "label", packed, f"i array<{kind}>, x binary, j array<{kind}>, y binary")
    made = met.mapInArrow(run, T.StructType([T.StructField("i", label), *[T.StructField(c, T.ArrayType(x, False)) for c, x in (("js", label), ("ds", T.DoubleType()))]]))
    each = made.select("i", "js", F.posexplode("ds").alias("k", "d")).where(F.col("d") != float("-inf"))
    return each.select("i", F.get("js", F.col("k")).alias("j"), F.when(~F.isnan("d"), F.col("d")).alias("d"))


def _determinant(f: list[list]) -> np.ndarray:
    """The determinants of 4 x 4 matrices, by the operations of ``_det`` in their order."""

    def det3(m):
        (a, b, c), (d, e, g), (h, i, k) = m
        return a * (e * k - g * i) - b * (d * k - g * h) + c * (d * i - e * h)

    terms = [f[0][col] * det3([[row[c] for c in range(4) if c != col] for row in f[1:]]) for col in range(4)]
    return terms[0] - terms[1] + terms[2] - terms[3]


def _whole_determinant(f: list[list]) -> np.ndarray:
    """The determinants of 4 x 4 matrices of whole numbers, by the minors of the first and of the last two rows."""
    upper, lower = ({(p, q): a[p] * b[q] - a[q] * b[p] for p in range(4) for q in range(p + 1, 4)} for a, b in (f[:2], f[2:]))
    return upper[0, 1] * lower[2, 3] - upper[0, 2] * lower[1, 3] + upper[0, 3] * lower[1, 2] + upper[1, 2] * lower[0, 3] - upper[1, 3] * lower[0, 2] + upper[2, 3] * lower[0, 1]


def _logdet(seqs: DataFrame, sites: int, pairwise_deletion: bool, digits: int | None) -> DataFrame:
    """(i, j, d) of the model logdet: values by the sites of a pair and the determinant of its counts, a whole number up to (sites / 4) ** 4.

    The determinant of the shares of a singular table is 0 or what rounding leaves of it, so these pairs have theirs computed one by one.
    """
    cells, most = [(x, y) for x in BASES for y in BASES], sites**4 // 256
    names = ["L", *[f"f_{x}{y}" for x, y in cells]]
    d = f"({_ln('det / L / L / L / L')}) / -4 - ln(4)"
    table = seqs.sparkSession.range((sites + 1) * (most + 1)).select("id", *[F.floor(x).cast("double").alias(k) for k, x in (("L", F.col("id") / (most + 1)), ("det", F.col("id") % (most + 1)))])
    table = table.where("L > 0 AND det > 0 AND 256 * det <= L * L * L * L").select("id", F.expr(d) if digits is None else F.round(F.expr(d), digits)).toPandas().to_numpy(float)
    values = np.full((sites + 1) * (most + 1), np.nan)
    values[table[:, 0].astype(int)] = table[:, 1]

    def coded(counter, rows):
        out, places, others = np.empty((rows.stop - rows.start, counter.m), np.intp), [], []
        for part, at in counter.parts(rows):
            known, *counts = (counter.counted(c, part, np.int16) for c in names)
            whole = _whole_determinant([counts[k : k + 4] for k in range(0, 16, 4)])
            np.multiply(known, most + 1, out=out[at], dtype=np.intp)
            out[at] += np.maximum(whole, 0)
            singular = np.flatnonzero((whole == 0) & (known > 0))
            shares = [c.ravel()[singular] / known.ravel()[singular].astype(float) for c in counts]
            left = _determinant([shares[k : k + 4] for k in range(0, 16, 4)])
            singular, left = singular[left > 0], np.log(left[left > 0]) / -4 - np.log(4)
            places.append(singular + at.start * counter.m)
            others.append(left if digits is None else np.round(left, digits))
        return out, np.concatenate(places), np.concatenate(others)

    def of(a, b):
        counter = _Counter(a, b, names)
        return lambda rows: coded(counter, rows)

    return pair_values(seqs, names, pairwise_deletion, values, most + 1, of)


def dist_dna(seqs: DataFrame, model: str = "k80", *, gamma: float | None = None, pairwise_deletion: bool = False, with_variance: bool = False, digits: int | None = None) -> DataFrame:
    """(i, j, d) and on request ``variance``: the distance of each pair of labels i < j; null where the model is undefined. ``digits``: rounded.

    Models of few counts take their values from a table of all combinations of these, the others are computed pair by pair.
    """
    if model == "indel":
        return dist_indel(seqs)
    seqs = settled(seqs.select("label", "seq"))
    out = {"d": formula(model, gamma)}
    if model == "bh87":
        out["d_back"] = formula("bh87_back")
    if with_variance:
        out["variance"] = variance(model)
    used = set(re.findall(r"\b(?:L|Nd|Ns1|Ns2|Nv1|Nv2|f_[acgt]{2})\b", " ".join(out.values()))) | {"L"}
    names = [c for c in _CELLS if c in used]
    sites = seqs.agg(F.max(F.length("seq"))).first()[0] or 0
    freq = {}
    if model in _NEED_FREQ:
        from sylva.operators.sequences import base_freq

        row = base_freq(seqs).agg(*[F.max(F.when(F.col("base") == b, F.col("freq"))).alias(f"p{b}") for b in BASES]).first()
        freq = {k: F.lit(v).cast("double") for k, v in row.asDict().items()}

    def made(counts: DataFrame, *keys: str) -> DataFrame:
        rows = counts.where("L > 0").select(*keys, *[F.col(c).cast("double").alias(c) for c in names]).withColumns(freq)
        cols = [F.expr(x).cast("double") if digits is not None else F.expr(x) for x in out.values()]
        return rows.select(*keys, *[(c if digits is None else F.round(c, digits)).alias(k) for k, c in zip(out, cols)])

    if model == "logdet" and len(out) == 1 and (sites + 1) * (sites**4 // 256 + 1) <= MOST_COMBINATIONS:
        return _logdet(seqs, sites, pairwise_deletion, digits)
    size = (sites + 1) ** len(names)
    if len(out) > 1 or size > MOST_COMBINATIONS:
        return made(pair_counts(seqs, names, pairwise_deletion, sites=sites), "i", "j")
    digit = {c: F.pmod(F.floor(F.col("id") / (sites + 1) ** k), F.lit(sites + 1)).cast("int").alias(c) for k, c in enumerate(reversed(names))}
    parts = [c for c in names if c not in ("L", "Nd")]
    whole = "Nd" if "Nd" in names else "L"
    possible = " AND ".join([f"{whole} <= L", *([f"{' + '.join(parts)} <= {whole}"] if parts else [])])
    table = made(seqs.sparkSession.range(size).select("id", *digit.values()).where(possible), "id").toPandas()
    values = np.full(size, np.nan)
    values[table["id"].to_numpy()] = table["d"].to_numpy(float)
    return pair_values(seqs, names, pairwise_deletion, values, (sites + 1) ** (len(names) - 1), _coded(names, sites))


def dist_indel(seqs: DataFrame) -> DataFrame:
    """(i, j, d): sites where exactly one of the two has a gap."""
    bits = F.regexp_replace(F.regexp_replace("seq", "[^-]", "0"), "-", "1")
    words = F.sequence(F.lit(0), F.floor((F.length("seq") - 1) / WORD).cast("int"))
    m = seqs.select("label", F.transform(words, lambda w: F.conv(F.substring(bits, w * WORD + 1, F.lit(WORD)), 2, 10).cast("long")).alias("m"))
    a, b = m.toDF("i", "a"), m.toDF("j", "b")
    d = F.aggregate(F.zip_with("a", "b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v).cast("long")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", d.alias("d"))


def dist_indel_blocks(seqs: DataFrame) -> DataFrame:
    """(i, j, d): sites where the lengths of the gap blocks that start there differ (none counts as 0)."""
    from sylva.operators.sequences import gap_blocks

    blocks = gap_blocks(seqs)
    per = blocks.groupBy("label").agg(F.map_from_entries(F.collect_list(F.struct("pos", "len"))).alias("m"))
    m = seqs.select("label").join(per, "label", "left").select("label", F.coalesce("m", F.create_map().cast("map<bigint,bigint>")).alias("m"))
    a, b = m.toDF("i", "a"), m.toDF("j", "b")
    keys = F.array_union(F.map_keys("a"), F.map_keys("b"))
    d = F.size(F.filter(keys, lambda k: F.coalesce(F.element_at("a", k), F.lit(0)) != F.coalesce(F.element_at("b", k), F.lit(0)))).cast("long")
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", d.alias("d"))


def ftab(seqs: DataFrame) -> DataFrame:
    """(x, y, n): the joint base table summed over all pairs of labels i < j."""
    counts = joint_counts(seqs, pairwise_deletion=True)
    sums = counts.agg(*[F.sum(f"f_{x}{y}").alias(f"f_{x}{y}") for x in BASES for y in BASES])
    cells = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(f"f_{x}{y}").alias("n")) for x in BASES for y in BASES])
    return sums.select(F.explode(cells).alias("c")).select("c.*")


def dist_aa(seqs: DataFrame, pairwise_deletion: bool = True, scaled: bool = False) -> DataFrame:
    """(i, j, d): differing amino acids; sites with X are left out of the pair, or of all pairs."""
    s = seqs.select("label", F.split(F.upper("seq"), "").alias("s"))
    if not pairwise_deletion:
        bad = s.select(F.posexplode("s").alias("p", "aa")).where("aa = 'X'").agg(F.collect_set("p").alias("bad"))
        s = s.crossJoin(F.broadcast(bad)).select("label", F.filter("s", lambda x, i: ~F.array_contains("bad", i)).alias("s"))
    a, b = s.toDF("i", "a"), s.toDF("j", "b")
    both = F.zip_with("a", "b", lambda x, y: F.when((x == "X") | (y == "X"), F.lit(None)).otherwise((x != y).cast("int")))
    n = F.aggregate(both, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0)))
    known = F.size(F.filter(both, lambda v: v.isNotNull()))
    pairs = a.join(b, F.col("i") < F.col("j"))
    return pairs.select("i", "j", (n / F.nullif(known, F.lit(0)) if scaled else n.cast("long")).alias("d"))


def dist_gene(loci: DataFrame, percentage: bool = False) -> DataFrame:
    """(i, j, d) over (label, alleles array): loci with different alleles; loci with a null are left out of the pair."""
    a, b = loci.select(F.col("label").alias("i"), F.col("alleles").alias("a")), loci.select(F.col("label").alias("j"), F.col("alleles").alias("b"))
    both = F.zip_with("a", "b", lambda x, y: (x != y).cast("int"))
    n = F.aggregate(both, F.lit(0), lambda acc, v: acc + F.coalesce(v, F.lit(0))).cast("long")
    known = F.size(F.filter(both, lambda v: v.isNotNull()))
    return a.join(b, F.col("i") < F.col("j")).select("i", "j", (n / F.nullif(known, F.lit(0)) if percentage else n).alias("d"))
