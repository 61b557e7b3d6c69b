"""Numpy work on Arrow batches and pandas groups, run inside Spark tasks.

The module is sent to the executors by value, so they need not have the package
installed.
"""

from __future__ import annotations

import difflib
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Scores closer than this count as equal, so that ties break by key on any batch layout.
SCORE_DIGITS = 9


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; zero rows become NaN and match nothing."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def list_matrix(column) -> np.ndarray:
    """An Arrow list column of equal lengths as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = np.asarray(column.flatten(), dtype=np.float64)
    return flat.reshape(len(column), -1)


def best_rows(scores: np.ndarray, ties: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of ``scores`` the positions of its ``k`` best columns, ties by ``ties``.
    Returns (row, column) index arrays; -inf never counts."""
    picked_rows, picked_cols = [], []
    for i, row in enumerate(scores):
        allowed = np.flatnonzero(row > -np.inf)
        if len(allowed) > k:
            cut = -np.partition(-row[allowed], k - 1)[k - 1]
            allowed = allowed[row[allowed] >= cut]
        order = np.lexsort((ties[allowed], -row[allowed]))[:k]
        picked_rows.append(np.full(len(order), i))
        picked_cols.append(allowed[order])
    if not picked_rows:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(picked_rows), np.concatenate(picked_cols)


def similarity(queries: np.ndarray, query_groups, items: np.ndarray, item_groups, relation: str) -> np.ndarray:
    """Cosine of every query with every item of a batch; pairs the relation excludes get -inf."""
    scores = np.round(unit_rows(queries) @ unit_rows(items).T, SCORE_DIGITS)
    scores[np.isnan(scores)] = -np.inf
    if relation != "any":
        codes: dict = {}
        left, right = (np.array([codes.setdefault(g, len(codes)) for g in groups], dtype=np.int64) for groups in (query_groups, item_groups))
        same = left[:, None] == right[None, :]
        scores[~same if relation == "same" else same] = -np.inf
    return scores


# Cells of one score matrix: 32 MB.
SCORE_CELLS = 4_000_000


def batch_matcher(query_ids, query_groups, queries, k: int, relation: str):
    """A ``mapInArrow`` function: the ``k`` best items of a task for each query.

    Batches hold item_id, item_group and embedding. Only the running best are
    kept, and a query is looked at again only when a batch beats its worst.
    """

    def run(batches):
        size = len(query_ids)
        kept_scores = [np.empty(0)] * size
        kept_ids = [np.empty(0, dtype=str)] * size
        kept_groups = [np.empty(0, dtype=object)] * size
        worst = np.full(size, -np.inf)
        step = max(1, SCORE_CELLS // max(size, 1))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                items = list_matrix(batch.column("embedding"))
                ids = np.array(batch.column("item_id").to_pylist(), dtype=str)
                groups = np.array(batch.column("item_group").to_pylist(), dtype=object)
                scores = similarity(queries, query_groups, items, groups, relation)
                for q in np.flatnonzero(((scores >= worst[:, None]) & (scores > -np.inf)).any(axis=1)):
                    better = np.flatnonzero((scores[q] >= worst[q]) & (scores[q] > -np.inf))
                    all_scores = np.concatenate([kept_scores[q], scores[q, better]])
                    all_ids = np.concatenate([kept_ids[q], ids[better]])
                    all_groups = np.concatenate([kept_groups[q], groups[better]])
                    _, best = best_rows(all_scores[None, :], all_ids, k)
                    kept_scores[q], kept_ids[q], kept_groups[q] = all_scores[best], all_ids[best], all_groups[best]
                    if len(best) == k:
                        worst[q] = kept_scores[q][-1]
        counts = [len(s) for s in kept_scores]
        if sum(counts):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.repeat(np.array(query_ids, dtype=object), counts).tolist(), pa.string()),
                    pa.array(np.concatenate(kept_ids).tolist(), pa.string()),
                    pa.array(np.concatenate(kept_groups).tolist(), pa.string()),
                    pa.array(np.concatenate(kept_scores), pa.float64()),
                ],
                names=["query_id", "item_id", "item_group", "score"],
            )

    return run


def block_matcher(k: int, relation: str):
    """A cogrouped Arrow function: the ``k`` best items of one block for each query of another. Scores are held for
    ``SCORE_CELLS`` pairs at a time."""
    names = ["query_id", "item_id", "item_group", "score"]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            items = list_matrix(right.column("embedding"))
            ids = np.array(right.column("item_id").to_pylist(), dtype=str)
            groups = right.column("item_group").to_pylist()
            step = max(1, SCORE_CELLS // right.num_rows)
            for start in range(0, left.num_rows, step):
                part = left.slice(start, step)
                scores = similarity(list_matrix(part.column("embedding")), part.column("query_group").to_pylist(), items, groups, relation)
                rows, cols = best_rows(scores, ids, k)
                taken = right.select(["item_id", "item_group"]).take(pa.array(cols, pa.int64()))
                queries = part.column("query_id").take(pa.array(rows, pa.int64()))
                found.append(pa.table([queries, *taken.columns, pa.array(scores[rows, cols], pa.float64())], names=names))
        if not found:
            return pa.table([pa.array([], pa.string())] * 3 + [pa.array([], pa.float64())], names=names)
        return pa.concat_tables(found)

    return run


# Cosines come out of rounded sums: a cell is skipped only where it is out of reach by more than this.
ANGLE_SLACK = 1e-6


def angles(matrix: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Angle of every row with every centre; NaN for rows without a direction, infinite for such centres."""
    cosine = unit_rows(matrix) @ np.nan_to_num(unit_rows(centres)).T
    found = np.arccos(np.clip(cosine, -1.0, 1.0))
    found[:, ~centres.any(axis=1)] = np.inf
    found[np.isnan(cosine).any(axis=1)] = np.nan
    return found


def matrix_steps(batches, column: str, width: int):
    """(slice of a batch, its vectors), so many rows at a time that ``width`` numbers a row stay small."""
    step = max(1, SCORE_CELLS // max(width, 1))
    for whole in batches:
        for start in range(0, whole.num_rows, step):
            batch = whole.slice(start, step)
            yield batch, list_matrix(batch.column(column))


def cell_finder(centres: np.ndarray):
    """A ``mapInArrow`` function: appends the nearest cell and the angle to its centre; -1 and null without a direction."""

    def run(batches):
        for batch, vectors in matrix_steps(batches, "embedding", len(centres)):
            found = angles(vectors, centres)
            lost = np.isnan(found).any(axis=1)
            cell = np.where(lost, -1, np.argmin(np.where(lost[:, None], 0.0, found), axis=1))
            angle = pa.array(found[np.arange(len(cell)), np.maximum(cell, 0)], pa.float64(), mask=lost)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), angle], [*batch.schema.names, "cell", "angle"])

    return run


def cell_visitor(centres: np.ndarray, radii: np.ndarray, first: int, within: bool):
    """A ``mapInArrow`` function: one row (query_id, query_group, embedding, _g) for every cell that a query visits.

    Either its ``first`` nearest cells that hold rows; or, ``within`` reach, all others that may hold a row of
    at least the column ``bound`` (null: any): such a cell has a row no nearer than the angle to its centre
    less its radius. Empty cells have a radius of -1.
    """
    filled = radii >= 0

    def run(batches):
        for batch, vectors in matrix_steps(batches, "embedding", len(centres)):
            found = angles(vectors, centres)
            known = ~np.isnan(found).any(axis=1)
            found = np.where(filled, found, np.inf)
            order = np.argsort(found, axis=1, kind="stable")
            near = np.zeros(found.shape, bool)
            np.put_along_axis(near, order[:, :first], True, axis=1)
            visits = near & filled & known[:, None]
            if within:
                bound = np.asarray(batch.column("bound").to_pylist(), dtype=np.float64)  # null becomes NaN
                best = np.cos(np.clip(np.where(filled, found, np.pi) - radii, 0.0, np.pi)) + ANGLE_SLACK
                visits = ~near & filled & known[:, None] & ~(best < bound[:, None])
            rows, cells = np.nonzero(visits)
            kept = batch.select(["query_id", "query_group", "embedding"]).take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(cells, pa.int32())], [*kept.schema.names, "_g"])

    return run


def cell_places(centres: np.ndarray, radii: np.ndarray):
    """A ``mapInArrow`` function: the place (from 1) of a row's cell in the order in which its vector visits cells."""
    filled = radii >= 0

    def run(batches):
        for batch, vectors in matrix_steps(batches, "embedding", len(centres)):
            order = np.argsort(np.where(filled, angles(vectors, centres), np.inf), axis=1, kind="stable")
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            place = np.argmax(order == cell[:, None], axis=1) + 1
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32())], ["place"])

    return run


def letter_masks(text: str) -> dict[str, int]:
    """For every letter the bit set of its positions."""
    masks: dict[str, int] = {}
    for i, letter in enumerate(text):
        masks[letter] = masks.get(letter, 0) | (1 << i)
    return masks


def common_subsequence(text: str, masks: dict[str, int], length: int) -> int:
    """Length of the longest common subsequence, bit-parallel (Hyyro 2004)."""
    full = (1 << length) - 1
    open_bits = full
    for letter in text:
        met = open_bits & masks.get(letter, 0)
        open_bits = ((open_bits + met) | (open_bits - met)) & full
    return length - open_bits.bit_count()


def text_ratio(new: pd.Series, old: pd.Series, above: float) -> pd.Series:
    """Ratcliff-Obershelp ratio of case-folded texts; 0 where it is at most ``above``.

    Upper bounds decide most pairs: lengths, letter counts, and the longest
    common subsequence, of which the matched blocks are one. What the matcher
    learns about an old text is kept for all new texts it meets.
    """
    scores = np.zeros(len(new))
    folded = [text.casefold() for text in new]
    places: dict[str, list[int]] = {}
    for i, text in enumerate(old):
        places.setdefault(text, []).append(i)
    for text, at in places.items():
        text = text.casefold()
        masks = letter_masks(text)
        matcher = difflib.SequenceMatcher(None, "", text)
        for i in at:
            matcher.set_seq1(folded[i])
            if matcher.real_quick_ratio() <= above or matcher.quick_ratio() <= above:
                continue
            if 2.0 * common_subsequence(folded[i], masks, len(text)) / (len(text) + len(folded[i])) > above:
                scores[i] = matcher.ratio()
    return pd.Series(np.where(scores > above, scores, 0.0))


def letter_runs(texts: pd.Series, sizes: tuple[int, ...], different: bool) -> pd.Series:
    """Runs of so many letters of each text as numbers: three letters at most take 21 bits each and stay apart, of
    more letters 16 bits each are kept, so rare signs may look alike."""
    out = []
    for text in texts:
        codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4").astype(np.int64) + 1
        found = []
        for n in sizes:
            bits = 21 if n <= 3 else 16
            m = max(len(codes) - n + 1, 0)
            run = np.zeros(m, np.int64)
            for i in range(n):
                run = (run << bits) | (codes[i : i + m] & ((1 << bits) - 1))
            found.append(run)
        runs = np.concatenate(found)
        out.append(np.unique(runs) if different else runs)
    return pd.Series(out, index=texts.index, dtype=object)


PAIR_SUMS = "pair int, n double, sx double, sy double, sxx double, syy double, sxy double"


def pair_sums(pairs: list[tuple[int, int, int]]):
    """A ``mapInArrow`` function: per task one row of sums for each pair of columns, over the rows
    where both are present."""
    number = np.array([p[0] for p in pairs], dtype=np.int32)
    first, second = np.array([p[1] for p in pairs]), np.array([p[2] for p in pairs])

    def run(batches):
        total = None
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns])
            here = (~np.isnan(x)).astype(np.float64)
            x = np.where(here > 0, x, 0.0)
            # Entry (i, j): sums over rows where both are present, of 1, x_i, x_i squared, x_i x_j.
            sums = np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
            total = sums if total is None else total + sums
        if total is None:
            return
        n, s, q, p = total
        columns = [n[first, second], s[first, second], s[second, first], q[first, second], q[second, first], p[first, second]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(number), *[pa.array(c) for c in columns]], names=["pair", "n", "sx", "sy", "sxx", "syy", "sxy"]
        )

    return run


def centre_distances(columns: list[np.ndarray], centres: np.ndarray) -> np.ndarray:
    """Squared distances: a row for each centre, a column for each point."""
    away = np.zeros((len(centres), len(columns[0])))
    for i, x in enumerate(columns):
        away += np.square(x - centres[:, i, None])
    return away


def point_packer(batches):
    """A ``mapInArrow`` function: each batch of points becomes one row, its columns end to end."""
    for batch in batches:
        if batch.num_rows:
            columns = [np.asarray(c.to_numpy(zero_copy_only=False), dtype=np.float64) for c in batch.columns]
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(columns).tobytes()], pa.binary())], names=["points"])


def centre_sums(models: list[np.ndarray]):
    """A ``mapInArrow`` function over packed points: per task, for each model (centres as rows) and each of its centres,
    the sums of the points nearest to it (part 0, 1, ... by column), their number and their squared distances."""
    width = models[0].shape[1]

    def run(batches):
        totals = [np.zeros((width + 2, len(c))) for c in models]
        for block in (v for batch in batches for v in batch.column(0)):
            x = list(np.frombuffer(block.as_buffer(), np.float64).reshape(width, -1))
            for centres, total in zip(models, totals):
                away = centre_distances(x, centres)
                near = away.argmin(axis=0)
                for i, weights in enumerate([*x, None, away.min(axis=0)]):
                    total[i] += np.bincount(near, weights, len(centres))
        for m, total in enumerate(totals):
            part, centre = np.indices(total.shape, dtype=np.int32)
            columns = [np.full(total.size, m, np.int32), centre.ravel(), part.ravel(), total.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["model", "centre", "part", "total"])

    return run


#: Bounds of both parameters, and how many grid points a side the search starts from.
ARMA_BOUND = 0.98
ARMA_SIDE = 15
#: Products of residual e and its derivatives p (by phi) and q (by theta) that a Gauss-Newton step needs.
FIRST, SECOND = np.array([0, 1, 2, 1, 0, 0]), np.array([0, 1, 2, 2, 1, 2])


def arma_grid() -> tuple[np.ndarray, np.ndarray]:
    steps = np.linspace(-ARMA_BOUND, ARMA_BOUND, ARMA_SIDE)
    p, q = np.meshgrid(steps, steps)
    return p.ravel(), q.ravel()


def strands(*series: np.ndarray):
    """Consecutive stretches of equal length side by side as (step, strand), then the rest as one strand."""
    n = len(series[0])
    length = max(int(np.sqrt(n)), 1)
    whole = n - n % length
    if whole:
        yield [x[:whole].reshape(-1, length).T for x in series]
    if whole < n:
        yield [x[whole:].reshape(-1, 1) for x in series]


def residual_map(now: np.ndarray, before: np.ndarray, phi: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """What a stretch does to the residual r before it, for many parameters: the last residual is m0 + m1 r,
    the sum of squares m2 + 2 m3 r + m4 r r. Residuals are e[t] = now[t] - phi before[t] - theta e[t-1]."""
    out = np.stack([np.zeros_like(phi), np.ones_like(phi), *[np.zeros_like(phi)] * 3])
    for a, b in strands(now, before):
        e = np.zeros((a.shape[1], len(phi)))
        c, s0, s1, s2 = np.ones_like(phi), np.zeros_like(e), np.zeros_like(e), np.zeros_like(phi)
        for x, y in zip(a, b):
            e = x[:, None] - phi * y[:, None] - theta * e
            c = -theta * c
            s0 += e * e
            s1 += e * c
            s2 += c * c
        for k in range(a.shape[1]):
            out = then(out, np.stack([e[k], c, s0[k], s1[k], s2]))
    return out


def then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One residual map after another."""
    e, c, s0, s1, s2 = first
    f, d, t0, t1, t2 = second
    return np.stack([f + d * e, d * c, s0 + t0 + 2 * t1 * e + t2 * e * e, s1 + t1 * c + t2 * e * c, s2 + t2 * c * c])


def newton_map(now: np.ndarray, before: np.ndarray, phi: float, theta: float) -> tuple[np.ndarray, np.ndarray]:
    """What a stretch does to the state (e, p, q, 1) before it, p and q the derivatives of e: the matrix that gives
    the state after it, and six matrices whose quadratic forms are the sums of the products FIRST by SECOND."""
    move, forms = np.eye(4), np.zeros((6, 4, 4))
    for a, b in strands(now, before):
        n = a.shape[1]
        z, sums = np.zeros((n, 3, 4)), np.zeros((n, 6, 4, 4))
        e, p, q, c, k = np.zeros(n), np.zeros(n), np.zeros(n), 1.0, 0.0
        for x, y in zip(a, b):
            q = -e - theta * q
            e = x - phi * y - theta * e
            p = -y - theta * p
            c, k = -theta * c, -c - theta * k
            z[:, 0, 0] = z[:, 1, 1] = z[:, 2, 2] = c
            z[:, 2, 0] = k
            z[:, 0, 3], z[:, 1, 3], z[:, 2, 3] = e, p, q
            sums += z[:, FIRST, :, None] * z[:, SECOND, None, :]
        for one, part in zip(z, sums):
            forms = forms + move.T @ part @ move
            move = np.vstack([one, [0.0, 0.0, 0.0, 1.0]]) @ move
    return move, forms


def search_start(totals: np.ndarray) -> tuple[float, float]:
    """The best grid point; equal fits (white noise has a ridge) go to the smallest parameters."""
    p, q = arma_grid()
    least = totals.min()
    best = np.lexsort((np.abs(p) + np.abs(q), np.round(totals / least, 9) if least > 0 else totals))[0]
    return float(p[best]), float(q[best])


#: State of a search: the point to look at, the best point and its sum, gradient, curvature and last residual, the
#: damping, and whether the search has ended.
SEARCH = ("phi", "theta", "best_phi", "best_theta", "best", "g0", "g1", "h00", "h01", "h11", "last", "damping", "done")


def search_state(phi: float, theta: float) -> dict[str, float]:
    return dict.fromkeys(SEARCH, 0.0) | {"phi": phi, "theta": theta, "best": np.inf, "damping": 1e-3}


def search_step(state: dict[str, float], sums: np.ndarray, last: float) -> dict[str, float]:
    """One damped Gauss-Newton step from the sums at the point looked at."""
    s = dict(state)
    if sums[0] < s["best"]:
        gain = s["best"] - sums[0]
        s.update(best_phi=s["phi"], best_theta=s["theta"], best=float(sums[0]), last=float(last), damping=max(s["damping"] / 10, 1e-12))
        s.update(h00=float(sums[1]), h11=float(sums[2]), h01=float(sums[3]), g0=float(sums[4]), g1=float(sums[5]))
        s["done"] = float(gain <= 1e-15 * sums[0])
    else:
        s["damping"] *= 10
        s["done"] = float(s["damping"] > 1e8)
    a, d, b = s["h00"] * (1 + s["damping"]), s["h11"] * (1 + s["damping"]), s["h01"]
    det = a * d - b * b
    if det <= 0:
        s["done"] = 1.0
        return s
    step = np.array([-(d * s["g0"] - b * s["g1"]), -(a * s["g1"] - b * s["g0"])]) / det
    point = np.array([s["best_phi"], s["best_theta"]])
    new = np.clip(point + step, -ARMA_BOUND, ARMA_BOUND)
    held = (np.abs(point) == ARMA_BOUND) & (new == point)
    if held.any():  # along the bound only the other parameter moves
        step = np.where(held, 0.0, -np.array([s["g0"], s["g1"]]) / np.array([a, d]))
        new = np.clip(point + step, -ARMA_BOUND, ARMA_BOUND)
    s["phi"], s["theta"] = float(new[0]), float(new[1])
    if np.abs(new - point).max() < 1e-11:
        s["done"] = 1.0
    return s


MAX_STEPS = 200


def fit_arma(w: np.ndarray) -> tuple[float, float, float, float]:
    """Conditional least squares for phi and theta of w[t] = phi w[t-1] + e[t] + theta e[t-1], from a residual of zero:
    the best of a grid, then damped Gauss-Newton -> phi, theta, residual variance, last residual."""
    now, before = w[1:], w[:-1]
    state = search_state(*search_start(residual_map(now, before, *arma_grid())[2]))
    for _ in range(MAX_STEPS):
        move, forms = newton_map(now, before, state["phi"], state["theta"])
        state = search_step(state, forms[:, 3, 3], move[0, 3])
        if state["done"]:
            break
    return state["best_phi"], state["best_theta"], state["best"] / max(len(w) - 1, 1), state["last"]


def arima_ahead(level: float, change: float, last: float, phi: float, theta: float, variance: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """ARIMA(1,1,1) without constant, from the last level, change and residual -> forecast means and standard errors."""
    changes = np.empty(steps)
    changes[0] = phi * change + theta * last
    for i in range(1, steps):
        changes[i] = phi * changes[i - 1]
    # Weights of past shocks on the level: running sums of 1, phi + theta, phi (phi + theta), ...
    psi = np.concatenate([[1.0], (phi + theta) * phi ** np.arange(steps - 1)])
    errors = np.sqrt(variance * np.cumsum(np.cumsum(psi) ** 2))
    return level + np.cumsum(changes), errors


def arima_forecast(y: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Forecast means and standard errors of a whole series."""
    w = np.diff(y)
    phi, theta, variance, last = fit_arma(w)
    return arima_ahead(y[-1], w[-1], last, phi, theta, variance, steps)


NORMAL_975 = 1.959963984540054


def ahead_columns(mean: np.ndarray, error: np.ndarray) -> dict[str, np.ndarray]:
    return {"i": np.arange(1, len(mean) + 1), "value": mean, "lower": mean - NORMAL_975 * error, "upper": mean + NORMAL_975 * error}


def block_packer(n_keys: int, size: int):
    """A ``mapInArrow`` function over rows (keys, us, value) in order: consecutive points of a series as one row of
    arrays, at most ``size`` points each -> keys, seq, n, us, value."""

    def run(batches):
        rows, held, seq, bulk = [], None, 0, 0
        kinds = names = None

        def out():
            arrays = [pa.array([r[i] for r in rows], kinds[i]) for i in range(n_keys)]
            arrays.append(pa.array([r[n_keys] for r in rows], pa.int64()))
            arrays.append(pa.array([len(r[n_keys + 1]) for r in rows], pa.int64()))
            arrays += [pa.array([r[n_keys + i].tobytes() for r in rows], pa.binary()) for i in (1, 2)]
            return pa.RecordBatch.from_arrays(arrays, names)

        def closed(upto):
            """Blocks of the points held, all of them or only full ones."""
            nonlocal seq, bulk
            us, value = np.concatenate(held[1]), np.concatenate(held[2])
            at = 0
            while len(us) - at >= size or (upto and at < len(us)):
                rows.append((*held[0], seq, us[at : at + size], value[at : at + size]))
                bulk += min(size, len(us) - at)
                seq, at = seq + 1, at + size
            held[1], held[2] = [us[at:]], [value[at:]]

        for batch in batches:
            if not batch.num_rows:
                continue
            kinds = [batch.column(i).type for i in range(n_keys)]
            names = [*batch.schema.names[:n_keys], "seq", "n", "us", "value"]
            us = batch.column(n_keys).to_numpy(zero_copy_only=False)
            value = np.asarray(batch.column(n_keys + 1).to_numpy(zero_copy_only=False), dtype=np.float64)
            new = np.zeros(len(us), bool)
            new[0] = True
            for i in range(n_keys):
                codes = batch.column(i).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                new[1:] |= codes[1:] != codes[:-1]
            cuts = np.append(np.flatnonzero(new), len(us))
            for a, z in zip(cuts[:-1], cuts[1:]):
                key = tuple(batch.column(i)[int(a)].as_py() for i in range(n_keys))
                if held is None or held[0] != key:
                    if held is not None:
                        closed(True)
                    held, seq = [key, [], []], 0
                held[1].append(us[a:z])
                held[2].append(value[a:z])
            if sum(map(len, held[1])) >= size:
                closed(False)
            if len(rows) >= 1000 or bulk >= 1 << 20:
                yield out()
                rows, bulk = [], 0
        if held is not None:
            closed(True)
        if rows:
            yield out()

    return run


def block_ends():
    """A ``mapInPandas`` function: blocks with the ends of their time and of their known values."""

    def run(frames):
        for pdf in frames:
            found = []
            for us, value in zip(pdf["us"], pdf["value"]):
                us, value = np.frombuffer(us, np.int64), np.frombuffer(value, np.float64)
                known = np.flatnonzero(~np.isnan(value))
                ends = [{"us": int(us[k]), "v": float(value[k])} for k in known[[0, -1]]] if len(known) else [None, None]
                found.append((int(us[0]), int(us[-1]), *ends, float(value[-2]) if len(value) > 1 else None))
            yield pdf.assign(**dict(zip(("us0", "us1", "first", "last", "second"), ([*x] for x in zip(*found)))))

    return run


def neighbours(keys: list[str]):
    """A ``mapInPandas`` function: neighbouring stamps within blocks."""

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                us = np.frombuffer(row["us"], np.int64)
                if len(us) > 1:
                    yield pd.DataFrame({"prev": us[:-1], "us": us[1:]}).assign(**{k: [row[k]] * (len(us) - 1) for k in keys})

    return run


def block_filler(keys: list[str]):
    """A ``mapInPandas`` function: points of blocks, missing values between the known ones around them."""

    def run(frames):
        for pdf in frames:
            for row in pdf.to_dict("records"):
                us, value = np.frombuffer(row["us"], np.int64), np.frombuffer(row["value"], np.float64)
                known = ~np.isnan(value)
                at, level = us[known], value[known]
                if row["before"] is not None:
                    at, level = np.append(row["before"]["us"], at), np.append(row["before"]["v"], level)
                if row["after"] is not None:
                    at, level = np.append(at, row["after"]["us"]), np.append(level, row["after"]["v"])
                if len(at) and not known.all():
                    right = np.searchsorted(at, us, "left")
                    left = np.clip(right - 1, 0, len(at) - 1)
                    right = np.minimum(right, len(at) - 1)
                    left = np.where(at[right] <= us, right, left)  # beyond the last known one
                    left = np.where(at[left] > us, right, left)  # before the first
                    width = (at[right] - at[left]).astype(np.float64)
                    share = np.divide((us - at[left]).astype(np.float64), width, out=np.zeros(len(us)), where=width > 0)
                    value = np.where(known, value, level[left] + (level[right] - level[left]) * share)
                yield pd.DataFrame({"us": us, "value": value}).assign(**{k: [row[k]] * len(us) for k in keys})

    return run


def block_changes(block, before: float | None, change: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Changes and the ones before them of a block of levels, given the last level and change before it; the first
    change of a series has none before it."""
    y = np.frombuffer(block, np.float64)
    w = np.diff(y) if before is None or np.isnan(before) else np.diff(y, prepend=before)
    if change is None or np.isnan(change):
        return w[1:], w[:-1]
    return w, np.concatenate([[change], w[:-1]])[: len(w)]


def whole_forecaster(keys: list[str], steps: int, min_points: int):
    """A ``mapInPandas`` function: forecasts of series that lie in one block."""

    def run(frames):
        for pdf in frames:
            out = []
            for row in pdf.to_dict("records"):
                y = np.frombuffer(row["value"], np.float64)
                if len(y) >= min_points:
                    out.append(pd.DataFrame({k: [row[k]] * steps for k in keys} | ahead_columns(*arima_forecast(y, steps))))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


def grid_mapper(keys: list[str]):
    """A ``mapInPandas`` function: the residual map of each block at every grid point."""

    def run(frames):
        for pdf in frames:
            maps = [residual_map(*block_changes(*x), *arma_grid()).tobytes() for x in zip(pdf["value"], pdf["before"], pdf["change"])]
            yield pdf[[*keys, "us0", "seq"]].assign(map=maps)

    return run


def grid_chooser(keys: list[str]):
    """A grouped pandas function: the maps of a series in order, and the search state at its best grid point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        whole = None
        for raw in pdf.sort_values(["us0", "seq"])["map"]:
            one = np.frombuffer(raw, np.float64).reshape(5, -1)
            whole = one if whole is None else then(whole, one)
        return pd.DataFrame([{k: pdf[k].iloc[0] for k in keys} | search_state(*search_start(whole[2]))])

    return run


def newton_mapper(keys: list[str]):
    """A ``mapInPandas`` function: the Gauss-Newton map of each block at the point its series looks at."""

    def run(frames):
        for pdf in frames:
            maps = []
            for x in zip(pdf["value"], pdf["before"], pdf["change"], pdf["phi"], pdf["theta"]):
                move, forms = newton_map(*block_changes(*x[:3]), *x[3:])
                maps.append(np.concatenate([move.ravel(), forms.ravel()]).tobytes())
            yield pdf[[*keys, "us0", "seq", *SEARCH]].assign(map=maps)

    return run


def newton_stepper(keys: list[str]):
    """A grouped pandas function: sums of a series through its maps in order, and the state after one step."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at, sums = np.array([0.0, 0.0, 0.0, 1.0]), np.zeros(6)
        for raw in pdf.sort_values(["us0", "seq"])["map"]:
            one = np.frombuffer(raw, np.float64)
            sums += np.einsum("i,kij,j->k", at, one[16:].reshape(6, 4, 4), at)
            at = one[:16].reshape(4, 4) @ at
        first = pdf.iloc[0]
        state = search_step({c: float(first[c]) for c in SEARCH}, sums, at[0])
        return pd.DataFrame([{k: first[k] for k in keys} | state])

    return run


def long_forecaster(keys: list[str], steps: int):
    """A ``mapInPandas`` function: forecasts from fitted states with the ends of their series."""

    def run(frames):
        for pdf in frames:
            out = []
            for r in pdf.to_dict("records"):
                ahead = arima_ahead(r["level"], r["end_change"], r["last"], r["best_phi"], r["best_theta"], r["best"] / max(r["points"] - 2, 1), steps)
                out.append(pd.DataFrame({k: [r[k]] * steps for k in keys} | ahead_columns(*ahead)))
            if out:
                yield pd.concat(out, ignore_index=True)

    return run


EULER = 0.5772156649015329


def average_path(n) -> np.ndarray:
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    with np.errstate(divide="ignore", invalid="ignore"):
        grown = 2.0 * (np.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n
    return np.where(n > 2, grown, np.where(n == 2, 1.0, 0.0))


def grow_tree(rows: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """One isolation tree: (node, feature, threshold, left, right, depth); leaves have feature -1
    and carry their expected path length."""
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    nodes = []
    todo = [(0, rows, 0)]
    n_nodes = 1
    while todo:
        node, part, depth = todo.pop()
        low, high = part.min(axis=0), part.max(axis=0)
        splittable = np.flatnonzero(high > low)
        if depth >= limit or len(part) <= 1 or len(splittable) == 0:
            nodes.append((node, -1, 0.0, -1, -1, depth + float(average_path(len(part)))))
            continue
        feature = int(rng.choice(splittable))
        threshold = float(rng.uniform(low[feature], high[feature]))
        goes_left = part[:, feature] <= threshold
        left, right = n_nodes, n_nodes + 1
        n_nodes += 2
        nodes.append((node, feature, threshold, left, right, 0.0))
        todo.append((left, part[goes_left], depth + 1))
        todo.append((right, part[~goes_left], depth + 1))
    return nodes


def tree_grower(n_features: int, seed: int):
    """A grouped pandas function from the rows of one tree (f0, f1, ... and their number _n) to its nodes."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        rows = pdf.sort_values("_n")[[f"f{i}" for i in range(n_features)]].to_numpy(dtype=np.float64)
        out = [(tree, *node) for node in grow_tree(rows, np.random.default_rng([seed, tree]))]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "threshold", "left", "right", "depth"])

    return run


def pack_forest(nodes: pd.DataFrame, tree_rows: int) -> dict:
    """Node rows as (tree, node) arrays. A leaf points to itself, so walks may overrun."""
    trees, width = int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1
    at = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    leaf = nodes["feature"].to_numpy() < 0
    packed = {name: np.zeros((trees, width), dtype=kind) for name, kind in
              (("feature", np.int32), ("threshold", float), ("left", np.int32), ("right", np.int32), ("depth", float))}
    packed["feature"][at] = np.where(leaf, 0, nodes["feature"])
    packed["threshold"][at] = nodes["threshold"]
    packed["left"][at] = np.where(leaf, nodes["node"], nodes["left"])
    packed["right"][at] = np.where(leaf, nodes["node"], nodes["right"])
    packed["depth"][at] = nodes["depth"]
    packed["levels"] = int(np.ceil(np.log2(tree_rows)))
    packed["normal"] = float(average_path(tree_rows))
    return packed


def forest_score(rows: np.ndarray, forest: dict) -> np.ndarray:
    """-2 ** (-mean path / expected path) per row."""
    rows = np.ascontiguousarray(rows)
    cells, starts = rows.ravel(), np.arange(len(rows), dtype=np.intp) * rows.shape[1]
    total = np.zeros(len(rows))
    for tree in range(len(forest["feature"])):
        feature, threshold = forest["feature"][tree].astype(np.intp), forest["threshold"][tree]
        # Children side by side, as flat reads are much faster: the left one of a node at twice its number.
        children = np.stack([forest["left"][tree], forest["right"][tree]], axis=1).astype(np.intp).ravel()
        node = np.zeros(len(rows), dtype=np.intp)
        for _ in range(forest["levels"]):
            at = feature.take(node)
            at += starts
            goes_right = ~(cells.take(at) <= threshold.take(node))
            node += node
            node += goes_right
            node = children.take(node)
        total += forest["depth"][tree].take(node)
    return -(2.0 ** (-(total / len(forest["feature"])) / forest["normal"]))
