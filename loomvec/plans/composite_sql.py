"""DuckDB SQL of the composite queries: compressed keys and their scores, evaluations, fidelity, allocation.

Each function writes the same steps as its query, from the raw table, as common table expressions;
only random constants (matrices, sketches, banks) and codebooks come from Python.
"""

from __future__ import annotations

import math

from ..functions import algebra as A
from ..operators import codebooks as C
from ..operators import compressors as P
from ..operators import rotations as R
from . import oracle as O

D = 64


def deq(bits: int, v: str) -> str:
    """Scalar round trip of a list."""
    c, b = C.lloyd_max(D, bits)
    return f"[{O.arr(c)}[{O.count_above('x', b)} + 1] for x in {v}]"


def sq(a: str, b: str, n: int = D) -> str:
    return f"list_sum([({a}[i] - {b}[i]) * ({a}[i] - {b}[i]) for i in range(1, {n + 1})])"


def compressed(p: str, src: str, bits: int, rotation: str = "wht", seed: int = 42, nsn: bool = True, full: bool = False, scaling: bool = False) -> str:
    """CTEs from src (h, k_id, vec) to <p>k (h, k_id, vec, km, rn, s) and <p>m (sk): rebuilt keys, residual norms, sketched residuals."""
    m, sk = R.make(rotation, D, seed).matrix, P.sketch_matrix(D, D, seed + 10_000)
    n1 = O.norm("x0") if full else "1e0"
    u = "[x / (n1 + 1e-8) for x in x0]" if full else "x0"
    out = [
        f"{p}m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt, {O.mat(sk)} as sk)",
        f"{p}1 as (select h, k_id, vec, {O.norm('vec')} as vn from {src})",
        f"{p}2 as (select *, [x / greatest(vn, 1e-12) for x in vec] as x0 from {p}1)",
    ]
    if nsn:
        out += [
            f"{p}3 as (select *, {n1} as n1 from {p}2), {p}4 as (select *, {u} as u from {p}3)",
            f"{p}a as (select list(a order by i) as mean from (select i, avg(u[i]) as a from {p}4, unnest(range(1, {D + 1})) as t(i) group by i))",
            f"{p}5 as (select {p}4.*, mean, [u[i] - mean[i] for i in range(1, {D + 1})] as c from {p}4, {p}a), {p}6 as (select *, {O.norm('c')} as n2 from {p}5)",
            f"{p}7 as (select *, [x / (n2 + 1e-8) for x in c] as x from {p}6)",
        ]
    else:
        out.append(f"{p}7 as (select *, x0 as x from {p}2)")
    back = "[(r[i] * n2 + mean[i]) * n1 * vn for i in range(1, 65)]" if nsn else "[y * vn for y in r]"
    out += [
        f"{p}8 as (select {p}7.*, m.mt, m.sk, {O.matvec('m.m', 'x')} as y from {p}7, {p}m m), {p}9 as (select *, {deq(max(1, bits - 1), 'y')} as z from {p}8)",
        f"{p}10 as (select *, {O.matvec('mt', 'z')} as r from {p}9), {p}11 as (select *, {back} as km0 from {p}10)",
        f"{p}12 as (select *, [greatest(-65504e0, least(65504e0, x)) for x in km0] as km1 from {p}11), {p}13 as (select *, [vec[i] - km1[i] for i in range(1, 65)] as e from {p}12)",
        f"{p}k as (select h, k_id, vec, {'[x * ' + O.dot('vec', 'vec') + ' / (' + O.dot('vec', 'km1') + ' + 1e-8) for x in km1]' if scaling else 'km1'} as km, greatest(-65504e0, least(65504e0, {O.norm('e')})) as rn, {O.matvec('sk', 'e')} as s from {p}13)",
    ]
    return ", ".join(out)


def packed(p: str, src: str, bits: int, seed: int = 42) -> str:
    """CTEs like compressed() for records whose norms are floats: what a record restores, its residual norm, its sketched residual."""
    m, sk = R.make("wht", D, seed).matrix, P.sketch_matrix(D, D, seed + 10_000)
    return f"""{p}m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt, {O.mat(sk)} as sk),
    {p}1 as (select h, k_id, vec, {O.norm('vec')} as vn from {src}), {p}2 as (select *, [x / greatest(vn, 1e-12) for x in vec] as u from {p}1),
    {p}a as (select list(a order by i) as mean from (select i, avg(u[i]) as a from {p}2, unnest(range(1, {D + 1})) as t(i) group by i)),
    {p}3 as (select {p}2.*, mean, [u[i] - mean[i] for i in range(1, {D + 1})] as c from {p}2, {p}a), {p}4 as (select *, {O.norm('c')} as n2 from {p}3), {p}5 as (select *, [x / (n2 + 1e-8) for x in c] as x from {p}4),
    {p}6 as (select {p}5.*, m.mt, m.sk, {O.matvec('m.m', 'x')} as y from {p}5, {p}m m), {p}7 as (select *, {deq(max(1, bits - 1), 'y')} as z from {p}6),
    {p}8 as (select *, {O.matvec('mt', 'z')} as r from {p}7), {p}9 as (select *, [(r[i] * n2::real::double + mean[i]) * vn::real::double for i in range(1, {D + 1})] as km from {p}8),
    {p}10 as (select *, [vec[i] - km[i] for i in range(1, {D + 1})] as e from {p}9), {p}k as (select h, k_id, vec, km, ({O.norm('e')})::real::double as rn, {O.matvec('sk', 'e')} as s from {p}10)"""


def topk_packed() -> str:
    return f"with {KEYS}, {packed('a', 'ks', 3)}, {estimates('a', 'qs')}, r as (select *, row_number() over (partition by q_id order by score desc, k_id) as rank from ae) select q_id, k_id, rank::int as rank, {O.r6('score', 'score')} from r where rank <= 5"


def rebuilt_keys() -> str:
    return f"with {O.KV}, ks as (select h, k_id, vec from k), {packed('a', 'ks', 3)} select k_id, (i - 1)::int as i, {O.r6('km[i]', 'x')} from ak, unnest(range(1, {D + 1})) as t(i)"


def estimates(p: str, queries: str, on: str = "q.h = k.h") -> str:
    """CTE <p>e (h, q_id, k_id, score) of queries (h, q_id, q)."""
    c = math.sqrt(math.pi / 2) / D
    return f"""{p}q as (select q.*, {O.matvec('m.sk', 'q')} as qp from {queries} q, {p}m m),
    {p}e as (select k.h, q_id, k_id, {O.dot('q', 'km')} + rn * {O.num(c)} * list_sum([case when s[i] >= 0 then qp[i] else -qp[i] end for i in range(1, {D + 1})]) as score from {p}q q join {p}k k on {on})"""


KEYS = f"{O.KV}, ks as (select h, k_id, vec from k), qs as (select h, k_id as q_id, vec as q from k where k_id % 50 = 0)"
EXACT = f"ex as (select k.h, q_id, k_id, {O.dot('q', 'vec')} as score from qs q join ks k on q.h = k.h)"


def topk_compressed() -> str:
    return f"with {KEYS}, {compressed('a', 'ks', 3)}, {estimates('a', 'qs')}, r as (select *, row_number() over (partition by q_id order by score desc, k_id) as rank from ae) select q_id, k_id, rank::int as rank, {O.r6('score', 'score')} from r where rank <= 5"


def estimate_quality() -> str:
    return f"""with {KEYS}, {EXACT}, {compressed('a', 'ks', 4)}, {estimates('a', 'qs')},
    j as (select x.q_id, x.k_id, x.score as x, e.score as y, row_number() over (partition by x.q_id order by x.score desc, x.k_id) as rx, row_number() over (partition by x.q_id order by e.score desc, x.k_id) as ry from ex x join ae e on x.q_id = e.q_id and x.k_id = e.k_id)
    select {O.r6('avg(y - x)', 'bias')}, {O.r6('sqrt(avg((y - x) * (y - x)))', 'rmse')}, {O.r6('corr(x, y)', 'corr')}, avg(case when rx = 1 then (ry = 1)::int end)::double as top1_match, avg(case when rx = 1 then (ry <= 5)::int end)::double as recall from j"""


def needle_compressed() -> str:
    parts = [f"with {O.KV}, n as (select count(*) // 3 as nth from k), ks as (select 0 as h, k_id, vec from k), qs as (select 0 as h, 0 as q_id, vec as q from k, n where k_id = nth)"]
    parts += [f"{compressed(f'b{b}', 'ks', b)}, {estimates(f'b{b}', 'qs')}" for b in (2, 3, 4)]
    return ", ".join(parts) + " " + " union all ".join(f"select {b} as bits, (select count(*) from b{b}e a, b{b}e z, n where z.k_id = nth and (a.score > z.score or a.score = z.score and a.k_id < z.k_id)) + 1 as rank" for b in (2, 3, 4))


def matched(p: str) -> str:
    """CTE <p>f (h, cosine, top1, top5) of <p>e against the exact scores."""
    return f"""{p}j as (select x.h, x.q_id, x.k_id, x.score as x, e.score as e, row_number() over (partition by x.q_id order by x.score desc, x.k_id) as rx, row_number() over (partition by x.q_id order by e.score desc, x.k_id) as re from ex x join {p}e e on x.q_id = e.q_id and x.k_id = e.k_id),
    {p}_t as (select q_id, e as e0 from {p}j where rx = 1), {p}g as (select h, j.q_id, sum(x * e) / (sqrt(sum(x * x)) * sqrt(sum(e * e))) as cos, max(case when rx = 1 and re = 1 then 1e0 else 0e0 end) as top1, case when count(*) filter (e > e0) < 5 then 1e0 else 0e0 end as top5 from {p}j j join {p}_t t on j.q_id = t.q_id group by h, j.q_id),
    {p}f as (select h, {O.r6('avg(cos)', 'cosine')}, {O.r6('avg(top1)', 'top1')}, {O.r6('avg(top5)', 'top5')} from {p}g group by h)"""


def evaluate_attention() -> str:
    return f"with {KEYS}, {EXACT}, {compressed('a', 'ks', 3)}, {estimates('a', 'qs')}, {matched('a')} select 0 as b, h, cosine, top1, top5, 3 as bits from af"


def evaluate_ablation() -> str:
    out = "[x * (case i - 1 when 3 then 10.0e0 when 31 then 8.0e0 when 47 then 6.0e0 else 1e0 end) for x, i in vec]"
    ctes, rows = [f"{O.KV}, ks as (select h, k_id, {out} as vec from k), qs as (select h, k_id as q_id, vec as q from k where k_id % 50 = 0)", EXACT], []
    for i, (name, rotation, nsn, packed, scaling) in enumerate((("haar", "haar", False, False, False), ("wht", "wht", False, False, False), ("nsn", "wht", True, False, False), ("packing", "wht", True, True, False), ("scaling", "wht", True, True, True))):
        ctes += [compressed(f"s{i}", "ks", 3, rotation, 42, nsn, False, scaling), estimates(f"s{i}", "qs"), matched(f"s{i}")]
        size = f"n * {D} * 2 / 8e0 + n * 8 + n * 4" + (f" + n * 4 + {D * 2}" if nsn else "") + ("" if packed else f" + n * {D - 8}")
        rows.append(f"select '{i} {name}' as step, 0 as b, h, cosine, top1, top5, ({size})::double as bytes from s{i}f, (select count(*) as n from ks)")
    return "with " + ", ".join(ctes) + " " + " union all ".join(rows)


TRIALS = (("haar 3", "haar", 3, False), ("wht 3", "wht", 3, False), ("nsn 3", "wht", 3, True), ("nsn 2", "wht", 2, True))


def trial_table() -> str:
    ctes = [f"{O.V}, ks as (select (vec_id % 3 * 16 + label)::int as h, vec_id as k_id, vec from v), qs as (select h, k_id as q_id, vec as q from ks qualify row_number() over (partition by h order by k_id) <= 2)", EXACT]
    for i, (_, rotation, bits, nsn) in enumerate(TRIALS):
        ctes += [compressed(f"s{i}", "ks", bits, rotation, 42, nsn), estimates(f"s{i}", "qs")]
    pairs = " union all ".join(f"select '{name}' as setting, {16.0 * D / (D * (bits - 1) + D + 32)!r}e0 as ratio, x.h, x.q_id, x.k_id, x.score as x, e.score as y from ex x join s{i}e e on x.q_id = e.q_id and x.k_id = e.k_id" for i, (name, _, bits, _) in enumerate(TRIALS))
    return f"""with {', '.join(ctes)}, p as ({pairs}), r as (select *, row_number() over (partition by setting, q_id order by x desc, k_id) as rx, row_number() over (partition by setting, q_id order by y desc, k_id) as ry from p),
    b as (select setting, q_id, y as y0 from r where rx = 1), q as (select r.setting, any_value(ratio) as ratio, h, r.q_id, count(*) as n, sum(x) as x, sum(y) as y, sum(x * x) as xx, sum(y * y) as yy, sum(x * y) as xy, sum(x * y) / (sqrt(sum(x * x)) * sqrt(sum(y * y))) as cos,
      max((rx = 1 and ry = 1)::int)::double as top1, (count(*) filter (y > y0) < 5)::int::double as top5, max((ry = 1 and k_id = r.q_id)::int)::double as hit from r join b on b.setting = r.setting and b.q_id = r.q_id group by r.setting, h, r.q_id),
    z as (select *, h // 16 as layer, h % 16 as head from q)
    select setting, coalesce(layer, -1) as layer, coalesce(head, -1) as head, count(*) as queries, sum(n)::bigint as pairs, {O.r6('(sum(y) - sum(x)) / sum(n)', 'bias')}, {O.r6('sqrt(greatest((sum(yy) - 2 * sum(xy) + sum(xx)) / sum(n), 0))', 'rmse')}, {O.r6('(sum(n) * sum(xy) - sum(x) * sum(y)) / (sqrt(sum(n) * sum(xx) - sum(x) * sum(x)) * sqrt(sum(n) * sum(yy) - sum(y) * sum(y)))', 'corr')},
    {O.r6('avg(cos)', 'cosine')}, {O.r6('avg(top1)', 'top1')}, {O.r6('avg(top5)', 'top5')}, {O.r6('avg(hit)', 'hits')}, {O.r6('any_value(ratio)', 'ratio')} from z group by grouping sets ((setting, layer, head), (setting, layer), (setting))"""


def hybrid_keys() -> str:
    return f"with {KEYS}, {compressed('a', 'ks', 3, 'hybrid', 42, True, True)} select h, {O.r6('sum(' + sq('vec', 'km') + f') / (count(*) * {D})', 'mse')} from ak group by h"


def evaluate_cache() -> str:
    ctes, rows = [KEYS], []
    for layer in (0, 1):
        ctes.append(compressed(f"l{layer}", "ks", 3, "wht", 1000 * layer))
        m = R.make("wht", D, 1000 * layer + 500).matrix
        ctes.append(f"v{layer}m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), v{layer}1 as (select vec, {O.norm('vec')} + 1e-8 as n, m, mt from ks, v{layer}m), v{layer}2 as (select vec, n, mt, {O.matvec('m', '[x / n for x in vec]')} as y from v{layer}1), v{layer}3 as (select vec, n, mt, {deq(3, 'y')} as z from v{layer}2), v{layer}4 as (select vec, [x * n for x in {O.matvec('mt', 'z')}] as r from v{layer}3)")
        mse = lambda r: O.r6("sum(" + sq("vec", r) + f") / (count(*) * {D})", "mse")
        rows.append(f"select {layer} as layer, 'k' as kind, count(*) as n, {mse('km')}, count(*) * {D * 2 / 8 + 8 + 8}::double as bytes from l{layer}k")
        rows.append(f"select {layer} as layer, 'v' as kind, count(*) as n, {mse('r')}, count(*) * {D * 3 / 8 + 2}::double as bytes from v{layer}4")
    return "with " + ", ".join(ctes) + " " + " union all ".join(rows)


def streamed_cache() -> str:
    m, sk, c = R.make("wht", D).matrix, P.sketch_matrix(D, D, 43), math.sqrt(math.pi / 2) / D
    return f"""with {O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt, {O.mat(sk)} as sk), u as (select vec_id, vec, mt, sk, {O.matvec('m', 'vec')} as y from v, m), z as (select vec_id, vec, mt, sk, {deq(2, 'y')} as z from u),
    w as (select vec_id, vec, sk, {O.matvec('mt', 'z')} as km from z), e as (select *, [vec[i] - km[i] for i in range(1, 65)] as e from w), k as (select vec_id, km, ({O.norm('e')})::real::double as rn, {O.matvec('sk', 'e')} as s from e),
    q as (select vec as q, {O.matvec('sk', 'vec')} as qp from v, m order by vec_id limit 1)
    select vec_id as pos, round({O.dot('q', 'km')} + rn * {O.num(c)} * list_sum([case when s[i] >= 0 then qp[i] else -qp[i] end for i in range(1, 65)]), 5) + 0.0 as score from k, q"""


# Rotations and quantizers


def rotation_quality(name: str = "hybrid") -> str:
    m = R.make(name, D).matrix
    return f"with {O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), u as (select vec, mt, {O.matvec('m', 'vec')} as y from v, m), w as (select vec, y, {O.matvec('mt', 'y')} as r from u), f as (select i, y[i] as y, y[i + 1] as z from w, unnest(range(1, 65)) as t(i)), s as (select i, var_samp(y) as v, abs(corr(y, z)) as c from f group by i) select '{name}' as rotation, {O.r6('(select sqrt(sum(' + sq('vec', 'r') + ')) / sqrt(sum(' + O.dot('vec', 'vec') + ')) from w)', 'invertibility')}, {O.r6('(select avg(abs(' + O.norm('y') + ' / ' + O.norm('vec') + ' - 1)) from w)', 'isometry')}, {O.r6('avg(v)', 'coord_variance')}, {O.r6('max(c)', 'max_cross_corr')} from s"


def rotation_score() -> str:
    m = R.make("wht", D).matrix
    out = "[x * (case i - 1 when 3 then 10.0e0 when 31 then 8.0e0 when 47 then 6.0e0 else 1e0 end) for x, i in vec]"
    return f"""with {O.V}, m as (select {O.mat(m)} as m), o as (select {out} as vec from v), u as (select vec, {O.matvec('m', 'vec')} as y from o, m),
    f as (select i, y[i] as x, y[i + 1] as nx from u, unnest(range(1, 65)) as t(i)), a as (select i, avg(x) as a from f group by i),
    s as (select i, count(*) as n, sum(power(x - a, 2)) as c2, sum(power(x - a, 4)) as c4, abs(corr(x, nx)) as c from f join a using (i) group by i),
    t as (select stddev_samp(c2 / (n - 1)) as u, avg(c) as c, avg(abs(c4 / n / power(sqrt(c2 / (n - 1)), 4) - 3)) as k from s), z as (select avg(abs({O.norm('y')} / ({O.norm('vec')} + 1e-8) - 1)) as e from u)
    select {O.r6('u', 'variance_uniformity')}, {O.r6('c', 'mean_cross_correlation')}, {O.r6('k', 'mean_excess_kurtosis')}, round(e, 5) + 0.0 as isometry_error, round(u * 100 + c * 100 + k * 10 + e * 1000, 4) + 0.0 as combined_score from t, z"""


def evaluate_rotations(names: tuple[str, ...] = ("haar", "wht", "cd8", "hybrid"), bits: tuple[int, ...] = (2, 3)) -> str:
    ctes, rows = [O.V], []
    for k, name in enumerate(names):
        r = R.make(name, D, 42)
        ctes.append(f"m{k} as (select {O.mat(r.matrix)} as m, {O.mat(r.matrix.T)} as mt), u{k} as (select vec, mt, {O.matvec('m', 'vec')} as y from v, m{k}), w{k} as (select vec, y, {O.matvec('mt', 'y')} as r, {', '.join(deq(b, 'y') + f' as q{b}' for b in bits)} from u{k})")
        rows += [f"select '{name}' as rotation, {r.elements} as elements, {b} as bits, {O.r6('sum(' + sq('y', f'q{b}') + f') / (count(*) * {D})', 'mse')}, {O.r6('sqrt(sum(' + sq('vec', 'r') + f') / (count(*) * {D}))', 'invertibility')}, {O.r6('avg(abs(' + O.norm('y') + ' / ' + O.norm('vec') + ' - 1))', 'isometry')} from w{k}" for b in bits]
    return "with " + ", ".join(ctes) + " " + " union all ".join(rows)


def e8_points(p: str, src: str) -> str:
    """CTEs from src (key, j, x) to <p>p (key, j, x, near): nearest points of E8, and the lists that lead there."""
    return f"""{p}0 as (select *, [round_even(t, 0) for t in x] as r, [round_even(t - 0.5e0, 0) for t in x] as h from {src}),
    {p}1 as (select *, [x[i] - r[i] for i in range(1, 9)] as dr, [x[i] - 0.5e0 - h[i] for i in range(1, 9)] as dh from {p}0),
    {p}2 as (select *, list_position([abs(t) for t in dr], list_max([abs(t) for t in dr])) as ir, list_position([abs(t) for t in dh], list_max([abs(t) for t in dh])) as ih from {p}1),
    {p}3 as (select *, [r[i] + case when i = ir and list_sum(r) % 2 <> 0 then case when dr[i] >= 0 then 1 else -1 end else 0 end for i in range(1, 9)] as a,
      [h[i] + 0.5e0 + case when i = ih and list_sum(h) % 2 <> 0 then case when dh[i] >= 0 then 1 else -1 end else 0 end for i in range(1, 9)] as b from {p}2),
    {p}p as (select *, case when {sq('x', 'b', 8)} < {sq('x', 'a', 8)} then b else a end as near from {p}3)"""


def e8_scale_search() -> str:
    steps = ", ".join(f"({i}, {O.num(k)})" for i, k in enumerate(C.SCALE_STEPS))
    return f"""with {O.V}, g as (select sqrt(sum({O.dot('vec', 'vec')}) / sum(len(vec))) as rms from v), k as (select step, rms * f as s from (values {steps}) t(step, f), g),
    e as (select step, s, [vec[j * 8 + i] / s for i in range(1, 9)] as x from v, k, unnest(range(0, 8)) as t(j)), {e8_points('n', 'e')}
    select step, {O.r6('any_value(s)', 'scale')}, {O.r6('sum(' + sq('x', 'near', 8) + ' * s * s) / (count(*) * 8)', 'mse')} from np group by step"""


def evaluate_quantizers(every: int = 50) -> str:
    m, codes = R.make("wht", D, 42).matrix, C.prefix_codebook("256")
    bits = {"scalar": 3.0, "e8": C.e8_bits_per_dimension(1), "z8_256": math.log2(len(codes)) / 8}
    ctes = [
        f"{O.V}, m as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), u as (select vec_id, vec, {O.matvec('m', 'vec')} as y from v, m), g as (select sqrt(sum({O.dot('y', 'y')}) / sum(len(y))) as rms from u)",
        f"scalar_z as (select vec_id, {deq(3, 'y')} as z from u)",
        f"e as (select vec_id, j, 4e0 * rms as s, [y[j * 8 + i] / (4e0 * rms + 1e-8) for i in range(1, 9)] as x from u, g, unnest(range(0, 8)) as t(j)), {e8_points('n', 'e')}, e8_z as (select vec_id, flatten(list([t * s for t in near] order by j)) as z from np group by vec_id)",
        f"c as (select code, c from (select unnest(range(0, {len(codes)})) as code, unnest({O.mat(codes)}) as c)), s as (select rms / ({O.num(C.rms(codes))} + 1e-8) as s from g), b as (select vec_id, j, s, [y[j * 8 + i] / (s + 1e-8) for i in range(1, 9)] as x from u, s, unnest(range(0, 8)) as t(j))",
        f"z as (select vec_id, j, any_value(s) as s, arg_min(c.c, ({sq('x', 'c.c', 8)}, code)) as near from b, c group by vec_id, j), z8_256_z as (select vec_id, flatten(list([t * s for t in near] order by j)) as z from z group by vec_id)",
    ]
    rows = []
    for name in ("scalar", "e8", "z8_256"):
        ctes.append(f"{name}_r as (select v.vec_id, vec, {O.matvec('mt', 'z')} as r from v join {name}_z using (vec_id), m), {name}_p as (select {O.dot('q.vec', 'k.vec')} as x, {O.dot('q.vec', 'k.r')} as y from {name}_r q, {name}_r k where q.vec_id % {every} = 0)")
        rows.append(f"select '{name}' as quantizer, {O.r6(O.num(bits[name]), 'bits_per_dim')}, {O.r6('(select sum(' + sq('vec', 'r') + f') / (count(*) * {D}) from {name}_r)', 'mse')}, {O.r6('avg(y - x)', 'bias')}, {O.r6('sqrt(avg((y - x) * (y - x)))', 'rmse')}, {O.r6('corr(x, y)', 'corr')} from {name}_p")
    return "with " + ", ".join(ctes) + " " + " union all ".join(rows)


def evaluate_variants() -> str:
    h, m = R.make("haar", D, 42).matrix, R.make("wht", D, 42).matrix
    mse = O.r6("sum(" + sq("u", "r") + f") / (count(*) * {D})", "mse")
    return f"""with {O.V}, n as (select vec, greatest({O.norm('vec')}, 1e-12) as n from v), u as (select [x / n for x in vec] as u from n), m as (select {O.mat(h)} as h, {O.mat(h.T)} as ht, {O.mat(m)} as m, {O.mat(m.T)} as mt),
    a1 as (select u, ht, {O.matvec('h', 'u')} as y from u, m), a2 as (select u, ht, {deq(3, 'y')} as z from a1), a3 as (select u, {O.matvec('ht', 'z')} as r from a2),
    mean as (select list(a order by i) as mean from (select i, avg(u[i]) as a from u, unnest(range(1, 65)) as t(i) group by i)), b1 as (select u, mean, [u[i] - mean[i] for i in range(1, 65)] as c from u, mean), b2 as (select *, {O.norm('c')} as n2 from b1),
    b3 as (select u, mean, n2, mt, {O.matvec('m', '[x / (n2 + 1e-8) for x in c]')} as y from b2, m), b4 as (select u, mean, n2, mt, {deq(3, 'y')} as z from b3), b5 as (select u, mean, n2, {O.matvec('mt', 'z')} as w from b4), b6 as (select u, [w[i] * n2 + mean[i] for i in range(1, 65)] as r from b5)
    select 'haar' as variant, 3 as bits, {mse} from a3 union all select 'nsn_wht' as variant, 3 as bits, {mse} from b6"""


def pca_invariants() -> str:
    return f"""with {O.V}, f as (select vec_id, i, vec[i] as x from v, unnest(range(1, 65)) as t(i)), c as (select a.i, b.i as j, covar_samp(a.x, b.x) as c from f a join f b on a.vec_id = b.vec_id group by a.i, b.i)
    select {O.r6('sum(case when i = j then c end)', 'total')}, {O.r6('sum(c * c)', 'squares')}, 64 as channels, true as falling from c"""


# Fidelity


def unit_plus(v: str) -> str:
    return f"[x / ({O.norm(v)} + 1e-8) for x in {v}]"


def ratios(p: str, src: str, part: str) -> str:
    """CTEs from src (part columns, s, a, q: lists of eight) to <p>r (part columns, s, pre, post, ratio) of consecutive triplets."""
    out = [f"{p}u as (select *, {O.norm('a')} + 1e-8 as na, {O.norm('q')} + 1e-8 as nq from {src})", f"{p}v as (select {part}, s, [x / na for x in a] as a0, [x / nq for x in q] as q0 from {p}u)"]
    leads = ", ".join(f"lead({c}0, {k}) over (partition by {part} order by s) as {c}{k}" for c in "aq" for k in (1, 2))
    out.append(f"{p}w as (select *, {leads} from {p}v), {p}x as (select * from {p}w where a2 is not null)")
    firsts = ", ".join(f"{A.product_sql(f'{c}0', f'{c}1', 8)} as {c}_l, {A.product_sql(f'{c}1', f'{c}2', 8)} as {c}_r" for c in "aq")
    seconds = ", ".join(f"{A.product_sql(f'{c}_l', f'{c}2', 8)} as {c}_ll, {A.product_sql(f'{c}0', f'{c}_r', 8)} as {c}_rr" for c in "aq")
    norm = lambda c: f"sqrt({sq(f'{c}_ll', f'{c}_rr', 8)}) / ({O.norm(f'{c}0')} * {O.norm(f'{c}1')} * {O.norm(f'{c}2')} + 1e-8)"
    out.append(f"{p}y as (select *, {firsts} from {p}x), {p}z as (select *, {seconds} from {p}y), {p}n as (select {part}, s, {norm('a')} as pre, {norm('q')} as post from {p}z), {p}r as (select *, case when abs(pre) < 1e-15 then 1e0 else post / pre end as ratio from {p}n)")
    return ", ".join(out)


def triplet_fidelity() -> str:
    return f"""with {O.KV}, c as (select h, s, vec, {deq(3, 'vec')} as y from k), t as (select h, j, s, vec[j * 8 + 1:j * 8 + 8] as a, y[j * 8 + 1:j * 8 + 8] as q from c, unnest(range(0, 8)) as u(j)), {ratios('f', 't', 'h, j')}
    select {O.r6('avg(ratio)', 'mean')}, {O.r6('min(ratio)', 'min')}, {O.r6('max(ratio)', 'max')}, {O.r6('stddev_samp(ratio)', 'std')}, {O.r6('avg(pre)', 'mean_pre')}, {O.r6('avg(post)', 'mean_post')}, count(*) as n from fr"""


def head_rotations(names: tuple[str, ...] = ("wht", "haar", "cd8", "hybrid")) -> str:
    ctes, rows = [f"{O.KV}, g as (select h, s, vec, greatest({O.norm('vec')}, 1e-12) as n from k), u as (select h, s, [x / n for x in vec] as x from g)"], []
    for i, name in enumerate(names):
        m = R.make(name, D, 42).matrix
        ctes.append(f"m{i} as (select {O.mat(m)} as m, {O.mat(m.T)} as mt), p{i} as (select h, s, x, mt, {O.matvec('m', 'x')} as y from u, m{i}), d{i} as (select h, s, x, mt, {deq(3, 'y')} as z from p{i}), w{i} as (select h, s, x, {O.matvec('mt', 'z')} as y from d{i})")
        ctes.append(f"t{i} as (select h, j, s, x[j * 8 + 1:j * 8 + 8] as a, y[j * 8 + 1:j * 8 + 8] as q from w{i}, unnest(range(0, 8)) as e(j)), {ratios(f'r{i}', f't{i}', 'h, j')}")
        ctes.append(f"c{i} as (select h, avg({O.dot('x', 'y')} / (greatest({O.norm('x')}, 1e-8) * greatest({O.norm('y')}, 1e-8))) as cos, count(*) as n from w{i} group by h), f{i} as (select h, avg(ratio) as f from r{i}r group by h)")
        rows.append(f"select c.h, '{name}' as rotation, case when n >= 3 then 0.3e0 * (1 - least(abs(coalesce(f, 1e0) - 1), 1e0)) + 0.7e0 * cos end as score from c{i} c left join f{i} f on c.h = f.h")
    return "with " + ", ".join(ctes) + f", a as ({' union all '.join(rows)}), b as (select *, row_number() over (partition by h order by score desc nulls last, rotation desc) as rn from a) select h, case when score is null then 'wht' else rotation end as rotation, {O.r6('score', 'score')} from b where rn = 1"


def rotation_counts() -> str:
    return f"with r as ({head_rotations()}) select rotation, count(*) as heads from r group by rotation"


def zero_divisor_quartiles() -> str:
    bank = A.random_unit(200, 16, 42)
    return f"""with {O.V}, q as (select vec_id, vec, {deq(2, 'vec')} as y from v), e as (select vec_id, [vec[i] - y[i] for i in range(1, 65)] as e from q), x as (select vec_id, {O.dot('e', 'e')} as err, e[1:16] as a from e), u as (select vec_id, err, a, {O.norm('a')} + 1e-8 as n from x), w as (select vec_id, err, [t / n for t in a] as a from u),
    b as (select unnest({O.mat(bank)}) as b), p as (select vec_id, err, {A.product_sql('a', 'b', 16)} as p from w, b), f as (select vec_id, any_value(err) as err, min({O.norm('p')}) as f from p group by vec_id),
    r as (select err, row_number() over (order by f, vec_id) - 1 as rn, count(*) over () as n from f) select least(rn // (n // 4), 3)::int as quartile, {O.r6('avg(err)', 'mean')} from r group by 1"""


# Allocation


def swept(source: str, budget: float, least: int, most: int, key: str) -> str:
    """Bits of regions of size one, source (key, goal): rounded goals, then three sweeps that hand out what rounding left, to those it moved farthest first."""
    out = [f"b0 as (select {key}, goal, greatest({least}, least({most}, round_even(goal, 0)))::int as bits from {source})"]
    for i in range(3):
        out.append(f"l{i} as (select *, trunc({O.num(budget)} * count(*) over ()) - sum(bits) over () as rest from b{i}), g{i} as (select *, sign(rest)::int as step, rest <> 0 and bits + sign(rest) between {least} and {most} as free from l{i})")
        out.append(f"o{i} as (select *, row_number() over (partition by free order by abs(goal - bits) desc, {key}) as rn from g{i}), b{i + 1} as (select {key}, goal, bits + case when free and rn <= abs(rest) then step else 0 end as bits from o{i})")
    return ", ".join(out)


def spectral_bits(slope: float) -> str:
    return f"""with {O.V}, e as (select i, avg(x * x) as e from (select i, vec[i] as x from v, unnest(range(1, 65)) as t(i)) group by i), l as (select i, ln(greatest(e, 1e-30)) as l from e), c as (select i - 1 as region, 3e0 + {O.num(slope)} * (l - (select avg(l) from l)) as goal from l), {swept('c', 3.0, 1, 8, 'region')} select region::int as region, bits::int as bits from b3"""


def layer_bits(slope: float) -> str:
    return f"""with {O.V}, s as (select label, var_samp(x) as v from (select label, unnest(vec) as x from v) group by label), w as (select label, (select max(v) from s) / (v + 1e-30) as v from s), l as (select label, ln(greatest(v, 1e-30)) as l from w), c as (select label, 3e0 + {O.num(slope)} * (l - (select avg(l) from l)) as goal from l), {swept('c', 3.0, 2, 4, 'label')} select label::int as layer, bits::int as bits from b3"""


def tower_given(p: str, src: str = "v", budget: float = 3.0, least: int = 2, most: int = 5) -> str:
    """CTE <p>t (level, dim, bits) of the tower's levels by their variances: three sweeps over regions of unlike sizes, region by region."""
    from ..operators.allocation import SLOPE

    levels = P.tower(D)
    rows = ", ".join(f"({k}, {lo}, {hi})" for k, (lo, hi) in enumerate(levels))
    m = len(levels)
    return f"""{p}l as (select * from (values {rows}) t(level, lo, hi)),
    {p}s as (select level, any_value(hi - lo) as dim, var_samp(vec[i]) as v from {src}, {p}l, unnest(range(1, {D + 1})) as t(i) where i > lo and i <= hi group by level),
    {p}g as (select list(dim order by level) as n, list({O.num(budget)} + {O.num(SLOPE)} * (ln(greatest(v, 1e-30)) - (select sum(dim * ln(greatest(v, 1e-30))) / {D} from {p}s)) order by level) as goal from {p}s),
    {p}w as (with recursive w as (
      select 0 as t, n, goal, [greatest({least}, least({most}, round_even(x, 0)::int)) for x in goal] as b, []::int[] as o, 0 as sgn from {p}g
      union all select t + 1, n, goal, case when i is not null and want <> 0 and abs(want) >= n[i] and b[i] + sg between {least} and {most} then [case when j = i then x + sg else x end for x, j in b] else b end, ord, sg
      from (select *, ord[t % {m} + 1] as i from (select *, case when t % {m} = 0 then [x.i for x in list_sort([{{'k': -abs(goal[j] - b[j]) * n[j], 'i': j}} for j in range(1, {m + 1}) if b[j] + sg between {least} and {most}])]::int[] else o end as ord
        from (select *, case when t % {m} = 0 then case when want > 0 then 1 else -1 end else sgn end as sg from (select *, (floor({O.num(budget)} * {D}) - list_sum([n[j] * b[j] for j in range(1, {m + 1})]))::int as want from w where t < {3 * m})))))
      select b, n from w where t = {3 * m}),
    {p}t as (select (k - 1)::int as level, n[k]::int as dim, b[k]::int as bits from {p}w, unnest(range(1, {m + 1})) as t(k))"""


def bit_allocations(slope: float) -> str:
    return f"""select 'spectral' as kind, region, bits from ({spectral_bits(slope)}) union all select 'layer', layer, bits from ({layer_bits(slope)})
    union all select 'tower', level, bits from (with {O.V}, {tower_given('tw')} select level, bits from twt)"""


def compare_with_uniform() -> str:
    levels, m = P.tower(D), R.make("wht", D).matrix
    err = lambda lo, hi, b, dim: f"(select avg(power(x - {O.arr(C.lloyd_max(dim, b)[0])}[{O.count_above('x', C.lloyd_max(dim, b)[1])} + 1], 2)) from (select unnest(y[{lo + 1}:{hi}]) as x from u))"
    curve = " union all ".join(f"select {k} as level, {hi - lo} as dim, {b} as bits, {err(lo, hi, b, hi - lo)} as mse" for k, (lo, hi) in enumerate(levels) for b in (2, 3, 4, 5))
    return f"""with {O.V}, m as (select {O.mat(m)} as m), u as (select {O.matvec('m', 'vec')} as y from v, m), c as ({curve}), {tower_given('tw')},
    g as (select *, min(gain) over (partition by level order by bits) as step from (select *, lag(mse) over (partition by level order by bits) - mse as gain from c)),
    s as (select *, case when step is null then 0 else dim end as cost, sum(case when step is null then dim * bits else dim end) over (order by step desc nulls first, level, bits) as spent from g),
    k as (select level, dim, max(bits) as bits, arg_max(mse, bits) as mse from s where step is null or spent <= {3 * D} and step > 0 group by level, dim),
    r as (select 'uniform' as method, 3e0 as bits, {err(0, D, 3, D)} as mse union all select 'variance', sum(c.dim * c.bits) / {D}e0, sum(c.dim * mse) / {D} from c join twt on c.level = twt.level and c.bits = twt.bits union all select 'curve', sum(dim * bits) / {D}e0, sum(dim * mse) / {D} from k)
    select method, {O.r6('bits', 'bits')}, {O.r6('mse', 'mse')}, {O.r6("((select mse from r where method = 'uniform') - mse) / ((select mse from r where method = 'uniform') + 1e-15)", 'gain')} from r"""


# Constants, by enumeration


def e8_root_counts() -> str:
    return """with w as (select [((id // (3 ** i)::bigint) % 3 - 1)::double for i in range(0, 8)] as r from range(6561) t(id)), h as (select [((id // (2 ** i)::bigint) % 2 - 0.5::double) for i in range(0, 8)] as r from range(256) t(id)),
    a as (select r, true as whole from w where list_sum([x * x for x in r]) = 2 union all select r, false from h where list_sum(r) % 2 = 0) select count(*)::int as roots, max(list_sum([x * x for x in r])) as norm_sq, count(*) filter (whole)::int as whole from a"""


def zero_divisor_pairs() -> str:
    unit = lambda *at: O.arr([{**{i: 0.0 for i in range(16)}, **dict(at)}[i] for i in range(16)])
    rows = [(1, unit((1, 1.0), (10, 1.0)), unit((4, 1.0), (15, -1.0))), (1, unit((1, 1.0), (10, 1.0)), unit((5, 1.0), (14, 1.0))), (2, unit((1, 1.0)), unit((2, 1.0)))]
    values = ", ".join(f"({p}, {a}, {b})" for p, a, b in rows)
    return f"with t as (select * from (values {values}) t(pair, a, b)), p as (select pair, a, b, {A.product_sql('a', 'b', 16)} as p from t) select pair, bool_or({O.norm('p')} < 1e-6 and {O.norm('a')} > 1e-6 and {O.norm('b')} > 1e-6) as zero from p group by pair"


def method_catalogue(d: int = D) -> str:
    """The counts by their formulas; 8, 30 and 84 are the reduced multiplications of blocks of 4, 8 and 16."""
    return f"""with n as (select {d} as d, log2({d})::int as l) select * from (select 'haar' as rotation, 'lloyd_max' as codebook, 3 as bits, d * d as params, d * d as mults, true as isometric from n union all select 'wht', 'lloyd_max', 3, 2 * d, d * l, true from n
    union all select 'cd' || b, 'lloyd_max', 3, d, (d // b * r)::int, b <= 8 from n, (values (4, 8), (8, 30), (16, 84)) t(b, r) where d % b = 0 union all select 'e8block', 'e8', 3, d // 2, (d // 16 * 30)::int, true from n where d % 16 = 0
    union all select 'clifford', 'lloyd_max', 3, (d // 3 * 4)::int, (d // 3 * 16)::int, true from n union all select 'wht', 'kmeans', 3, 2 * d, d * l, true from n)"""
