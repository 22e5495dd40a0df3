"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

VOX = """u AS (SELECT vec_id, unnest(range(0, 64)) AS i, unnest(embedding) AS e FROM embeddings),
v AS (SELECT (vec_id // 100)::INT AS t, ((vec_id // 20) % 5)::INT AS p, ((vec_id // 10) % 2)::INT AS c, (vec_id % 10)::INT AS z,
  (i // 8)::INT AS y, (i % 8)::INT AS x, round_even(least(65535.0, greatest(0.0, e::DOUBLE * 1000 + 2000)), 0)::INT AS v FROM u)"""


def _otsu(keys: str, step: int) -> str:
    """Table o (keys, threshold) of largest between-class variance over every ``step``-th voxel."""
    return f"""h AS (SELECT {keys}, v, count(*) AS n FROM v WHERE z % {step} = 0 AND y % {step} = 0 AND x % {step} = 0 GROUP BY ALL),
hc AS (SELECT {keys}, v, (sum(n) OVER r)::DOUBLE AS w0, (sum(n * v) OVER r)::DOUBLE AS s0,
  (sum(n) OVER (PARTITION BY {keys}))::DOUBLE AS w, (sum(n * v) OVER (PARTITION BY {keys}))::DOUBLE AS s
  FROM h WINDOW r AS (PARTITION BY {keys} ORDER BY v)),
hb AS (SELECT {keys}, v, CASE WHEN w - w0 > 0 THEN round(w0 * (w - w0) * (s0 / w0 - (s - s0) / (w - w0)) * (s0 / w0 - (s - s0) / (w - w0)), 3) ELSE -1 END AS b FROM hc),
o AS (SELECT {keys}, v AS threshold FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY b DESC, v) AS k FROM hb) WHERE k = 1)"""


OTSU, BOX_OTSU = _otsu("c", 4), _otsu("c", 8)

STAGE = """s AS (SELECT (s_suppkey - (SELECT min(s_suppkey) FROM supplier))::INT AS row FROM supplier),
stage AS (SELECT row, row * 4.0::DOUBLE AS x, (row % 2) * 2.0::DOUBLE AS y, 0.0::DOUBLE AS z, (row % 3) * 5.0::DOUBLE AS theta FROM s)"""

MATRIX = STAGE + """,
tm AS (SELECT row AS p, 1.0::DOUBLE AS m00, 0.0::DOUBLE AS m01, 0.0::DOUBLE AS m02, x AS m03,
  0.0::DOUBLE AS m10, cos(radians(theta)) AS m11, -sin(radians(theta)) AS m12, -y AS m13,
  0.0::DOUBLE AS m20, sin(radians(theta)) AS m21, cos(radians(theta)) AS m22, z AS m23 FROM stage)"""

BOXES = MATRIX + """,
corner AS (SELECT p, m00*a + m01*b + m02*d + m03 AS x, m10*a + m11*b + m12*d + m13 AS y, m20*a + m21*b + m22*d + m23 AS z
  FROM tm, (VALUES (0.0),(6.0)) ca(a), (VALUES (0.0),(4.0)) cb(b), (VALUES (0.0),(4.0)) cd(d)),
box AS (SELECT p, round(min(x), 6) + 0.0 AS min_x, round(max(x), 6) + 0.0 AS max_x, round(min(y), 6) + 0.0 AS min_y,
  round(max(y), 6) + 0.0 AS max_y, round(min(z), 6) + 0.0 AS min_z, round(max(z), 6) + 0.0 AS max_z FROM corner GROUP BY p)"""

EDGES = BOXES + """,
pair AS (SELECT a.p AS fixed, b.p AS moving, greatest(a.min_x, b.min_x) AS min_x, least(a.max_x, b.max_x) AS max_x,
  greatest(a.min_y, b.min_y) AS min_y, least(a.max_y, b.max_y) AS max_y, greatest(a.min_z, b.min_z) AS min_z, least(a.max_z, b.max_z) AS max_z
  FROM box a JOIN box b ON a.p < b.p),
edge AS (SELECT *, greatest(1, floor((max_x - min_x) / 0.5 + 1e-9)::BIGINT) * greatest(1, floor((max_y - min_y) / 0.5 + 1e-9)::BIGINT)
  * greatest(1, floor((max_z - min_z) / 1.0 + 1e-9)::BIGINT) AS overlap_voxels
  FROM pair WHERE min_x < max_x AND min_y < max_y AND min_z < max_z)"""

DET = """kinds AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS c FROM (SELECT DISTINCT event_type FROM events)),
det AS (SELECT (day(ts) - 1)::DOUBLE AS t, (user_id % 5)::DOUBLE AS p, c::DOUBLE AS c, hour(ts)::DOUBLE AS z, minute(ts)::DOUBLE AS y,
  second(ts)::DOUBLE AS x, (event_id % 3 + 1)::DOUBLE AS sigma, value AS intensity FROM events JOIN kinds USING (event_type))"""

RUNS = """runs AS (SELECT o_custkey AS store, o_orderkey AS run_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END AS status,
  o_orderpriority AS parameters, o_orderkey % 7 = 0 AS skipped,
  row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS run_index FROM orders),
body AS (SELECT *, store || '|' || run_index || '|' || run_id || '|' || status || '|' || parameters AS text FROM runs),
chained AS (SELECT *, NULL::VARCHAR AS prev_hash, sha256(text || '|') AS self_hash FROM body WHERE run_index = 1
  UNION ALL SELECT b.*, a.self_hash, sha256(b.text || '|' || a.self_hash) FROM chained a JOIN body b ON b.store = a.store AND b.run_index = a.run_index + 1)"""

PATHS = """keys AS (SELECT DISTINCT t, p, c FROM v),
paths AS (SELECT format('/data/Position{}/CH{:02d}_{:06d}.tiff', p, c, t) AS path, t, p, c FROM keys)"""

GRID = """g AS (SELECT z0, least(z0 + {cz}, 10) AS z1, y0, least(y0 + {cy}, 8) AS y1, x0, least(x0 + {cx}, 8) AS x1
  FROM range(0, 10, {cz}) a(z0), range(0, 8, {cy}) b(y0), range(0, 8, {cx}) d(x0))"""


def _level(f: int) -> str:
    return f"SELECT t, p, c, (z // {f})::INT AS z, (y // {f})::INT AS y, (x // {f})::INT AS x, v FROM v WHERE z % {f} = 0 AND y % {f} = 0 AND x % {f} = 0"


def _fuse(weight: str) -> str:
    return f"""WITH {VOX}, w AS (SELECT t, c, z, y, x + 6 * p AS x, v, {weight} AS w FROM v)
SELECT t, c, z, y, x::INT AS x, least(65535, greatest(0, round_even(CASE WHEN sum(w) > 0 THEN sum(v::DOUBLE * w) / greatest(sum(w), 1e-6) ELSE 0 END, 0)))::INT AS v
FROM w GROUP BY t, c, z, y, x"""


PAIRS = """pr AS (SELECT a.c, a.v AS fixed, b.v AS moving FROM v a JOIN v b USING (t, c, z, y, x) WHERE b.p = a.p + 1)"""

ORACLES = {
    "mip_xy": f"WITH {VOX} SELECT t, p, c, y, x, max(v) AS v FROM v GROUP BY ALL",
    "mip_xz": f"WITH {VOX} SELECT t, p, c, z, x, max(v) AS v FROM v GROUP BY ALL",
    "mip_yz": f"WITH {VOX} SELECT t, p, c, z, y, max(v) AS v FROM v GROUP BY ALL",
    "mip_all_projections": f"""WITH {VOX} SELECT 'xy' AS projection, t, p, c, y AS a, x AS b, max(v) AS v FROM v GROUP BY ALL
UNION ALL SELECT 'xz', t, p, c, z, x, max(v) FROM v GROUP BY ALL UNION ALL SELECT 'yz', t, p, c, z, y, max(v) FROM v GROUP BY ALL""",
    "mip_export_tasks": f"WITH {VOX} SELECT DISTINCT t, c, projection FROM v, (VALUES ('xy'), ('xz'), ('yz')) n(projection)",
    "mip_resample_z": f"""WITH {VOX}, f AS (SELECT t, p, c, z, x, max(v) AS v FROM v GROUP BY ALL),
g AS (SELECT m, m * 9.0::DOUBLE / 18.0 AS pos FROM range(0, 19) r(m))
SELECT a.t, a.p, a.c, g.m::INT AS z, a.x, round_even(least(65535.0, greatest(0.0, a.v * (1 - (pos - floor(pos))) + b.v * (pos - floor(pos)))), 0)::INT AS v
FROM g JOIN f a ON a.z = floor(pos)::INT JOIN f b ON b.t = a.t AND b.p = a.p AND b.c = a.c AND b.x = a.x AND b.z = least(floor(pos)::INT + 1, 9)""",
    "canonical_projection": f"WITH {VOX} SELECT t, p, 0 AS c, z, y, x, v FROM v",
    "pyramid_l1": f"WITH {VOX} {_level(2)}",
    "pyramid_l2": f"WITH {VOX} {_level(4)}",
    "pyramid_chain_equals_direct": f"WITH {VOX} SELECT c, count(*) AS n, 0::BIGINT AS different FROM ({_level(4)}) GROUP BY c",
    "chunk_grid": f"WITH {GRID.format(cz=4, cy=3, cx=5)} SELECT z0::INT AS z_start, z1::INT AS z_stop, y0::INT AS y_start, y1::INT AS y_stop, x0::INT AS x_start, x1::INT AS x_stop FROM g",
    "halo_expand": f"""WITH {GRID.format(cz=5, cy=4, cx=4)} SELECT z0::INT AS z_start, z1::INT AS z_stop, y0::INT AS y_start, y1::INT AS y_stop, x0::INT AS x_start, x1::INT AS x_stop,
greatest(0, z0 - 1)::INT AS z_read_start, least(10, z1 + 1)::INT AS z_read_stop, greatest(0, y0 - 2)::INT AS y_read_start, least(8, y1 + 2)::INT AS y_read_stop,
greatest(0, x0 - 2)::INT AS x_read_start, least(8, x1 + 2)::INT AS x_read_stop FROM g""",
    "halo_replicate": f"""WITH {VOX}, {GRID.format(cz=5, cy=4, cx=4)} SELECT t, p, c, (z0 // 5)::INT AS z_chunk, (y0 // 4)::INT AS y_chunk, (x0 // 4)::INT AS x_chunk, count(*) AS n, sum(v)::BIGINT AS s
FROM v JOIN g ON z >= z0 AND z < z1 AND y >= y0 - 1 AND y < y1 + 1 AND x >= x0 - 1 AND x < x1 + 1 GROUP BY ALL""",
    "core_mask": f"WITH {DET} SELECT * FROM det WHERE z >= 4 AND z < 12 AND y >= 0 AND y < 30 AND x >= 10 AND x < 50",
    "median_border": f"""WITH {VOX}, m AS (SELECT t, p, c, quantile_cont(v, 0.5)::DOUBLE AS v FROM v GROUP BY ALL)
SELECT t, p, c, z, y, x, v::DOUBLE AS v FROM v UNION ALL
SELECT t, p, c, z::INT, y::INT, x::INT, v FROM m, range(-1, 11) a(z), range(-1, 9) b(y), range(-1, 9) d(x)
WHERE NOT (z BETWEEN 0 AND 9 AND y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7)""",
    "zero_mask": f"WITH {VOX} SELECT t, p, c, z, y, x, CASE WHEN v > 2000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mask FROM v",
    "grow_and_merge_boxes": f"""WITH {VOX}, {_otsu("t, c", 8)},
b AS (SELECT t, c, min(z) AS z0, max(z) + 1 AS z1, min(y) AS y0, max(y) + 1 AS y1, min(x) AS x0, max(x) + 1 AS x1 FROM v JOIN o USING (t, c) WHERE v > threshold GROUP BY t, c)
SELECT c, min(greatest(0, z0 - 1))::INT AS z_start, max(least(10, z1 + 1))::INT AS z_stop, min(greatest(0, y0 - 1))::INT AS y_start, max(least(8, y1 + 1))::INT AS y_stop,
min(greatest(0, x0 - 1))::INT AS x_start, max(least(8, x1 + 1))::INT AS x_stop FROM b GROUP BY c""",
    "crop_common_box": f"""WITH {VOX}, {_otsu("t, p, c", 8)},
b AS (SELECT t // 2 AS k, p, c, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM v JOIN o USING (t, p, c) WHERE v > threshold GROUP BY ALL)
SELECT v.* FROM v JOIN b ON v.t // 2 = b.k AND v.p = b.p AND v.c = b.c WHERE z BETWEEN z0 AND z1 AND y BETWEEN y0 AND y1 AND x BETWEEN x0 AND x1""",
    "voxel_budget_stride": """WITH a AS (SELECT p_partkey, p_size * 10 AS nz, p_size * 20 AS ny, p_size * 30 AS nx, (p_partkey % 7 + 1)::INT AS nt, (p_partkey % 5 + 1)::INT AS np FROM part),
b AS (SELECT *, CASE WHEN nz::DOUBLE * ny * nx * nt * np > 2000000 THEN greatest(1, ceil(cbrt(nz::DOUBLE * ny * nx * nt * np / 2000000) - 1e-9))::INT ELSE 1 END AS zyx_stride FROM a),
d AS (SELECT *, ceil(nz / zyx_stride) * ceil(ny / zyx_stride) * ceil(nx / zyx_stride) * nt * np AS n FROM b)
SELECT p_partkey, nz, ny, nx, nt, np, zyx_stride, CASE WHEN n > 2000000 THEN greatest(1, ceil(sqrt(n / 2000000) - 1e-9))::INT ELSE 1 END AS tp_stride FROM d""",
    "display_level_pick": f"""WITH {VOX}, l AS (SELECT f, count(*) FILTER (WHERE z % f = 0 AND y % f = 0 AND x % f = 0) AS n FROM v, (VALUES (1), (2), (4), (8)) a(f) GROUP BY f)
SELECT coalesce(min(log2(f)) FILTER (WHERE n <= 5000), 3)::INT AS level FROM l""",
    "flatfield_apply": f"""WITH {VOX}, pix AS (SELECT p, c, y, x, sum(v) AS s, count(*) AS n FROM v GROUP BY ALL),
prof AS (SELECT p, c, y, x, s::DOUBLE / n / ((sum(s) OVER w)::DOUBLE / (sum(n) OVER w)) AS flat FROM pix WINDOW w AS (PARTITION BY p, c))
SELECT t, p, c, z, y, x, round((v - 0.0::DOUBLE) / greatest(flat, 1e-6), 6) + 0.0 AS v FROM v JOIN prof USING (p, c, y, x)""",
    "flatfield_apply_timelapse": f"""WITH {VOX}, pix AS (SELECT p, c, y, x, sum(v) AS s, count(*) AS n FROM v GROUP BY ALL),
prof AS (SELECT p, c, y, x, s::DOUBLE / n / ((sum(s) OVER w)::DOUBLE / (sum(n) OVER w)) AS flat FROM pix WINDOW w AS (PARTITION BY p, c)),
pl AS (SELECT p, c, t, z, sum(v) AS s, count(*) AS n FROM v GROUP BY ALL),
base AS (SELECT p, c, t, z, s::DOUBLE / n - (sum(s) OVER w)::DOUBLE / (sum(n) OVER w) AS b FROM pl WINDOW w AS (PARTITION BY p, c))
SELECT t, p, c, z, y, x, round(v / greatest(flat, 1e-6) - b, 6) + 0.0 AS v FROM v JOIN prof USING (p, c, y, x) JOIN base USING (p, c, t, z)""",
    "flatfield_feather": "SELECT i::INT AS i, round(greatest(CASE WHEN i < 3 THEN (i + 1) / 4.0::DOUBLE WHEN i >= 9 THEN 1 - (i - 8) / 4.0::DOUBLE ELSE 1.0::DOUBLE END, 0.001), 6) AS w FROM range(0, 12) r(i)",
    "otsu_threshold": f"WITH {VOX}, {OTSU} SELECT c, threshold FROM o",
    "noise_normalized": f"WITH {VOX}, {OTSU}, d AS (SELECT c, stddev_pop(v) AS sd FROM v GROUP BY c) SELECT t, p, c, z, y, x, round((v - threshold) / sd, 6) + 0.0 AS v FROM v JOIN o USING (c) JOIN d USING (c)",
    "bbox_minimal": f"WITH {VOX}, {BOX_OTSU} SELECT c, min(z) AS z_start, max(z) + 1 AS z_stop, min(y) AS y_start, max(y) + 1 AS y_stop, min(x) AS x_start, max(x) + 1 AS x_stop FROM v JOIN o USING (c) WHERE v > threshold GROUP BY c",
    "bbox_robust": f"""WITH {VOX}, {BOX_OTSU}, a AS (SELECT c, z, y, x FROM v JOIN o USING (c) WHERE v > threshold),
m AS (SELECT c, 'z' AS axis, z AS i, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT c, 'y', y, count(*) FROM a GROUP BY ALL UNION ALL SELECT c, 'x', x, count(*) FROM a GROUP BY ALL),
r AS (SELECT *, sum(n) OVER (PARTITION BY c, axis ORDER BY i) AS cum, sum(n) OVER (PARTITION BY c, axis) AS total FROM m)
SELECT c, axis, min(i) FILTER (WHERE cum >= total * 5.0 / 100) AS start, (min(i) FILTER (WHERE cum >= total * 95.0 / 100) + 1)::INT AS stop FROM r GROUP BY c, axis""",
    "contrast_limits": f"WITH {VOX} SELECT c, round(quantile_cont(v, 0.01)::DOUBLE, 6) AS low, round(quantile_cont(v, 0.95)::DOUBLE, 6) AS high FROM ({_level(2)}) GROUP BY c",
    "intensity_fit": f"""WITH {VOX}, {PAIRS}, l AS (SELECT c, quantile_cont(moving, 0.01) AS m0, quantile_cont(moving, 0.99) AS m1, quantile_cont(fixed, 0.01) AS f0, quantile_cont(fixed, 0.99) AS f1 FROM pr WHERE fixed > 0 AND moving > 0 GROUP BY c),
k AS (SELECT c, fixed::DOUBLE AS f, moving::DOUBLE AS m FROM pr JOIN l USING (c) WHERE fixed > 0 AND moving > 0 AND moving BETWEEN m0 AND m1 AND fixed BETWEEN f0 AND f1),
a AS (SELECT c, count(*) AS n, avg(m) AS mm, avg(f) AS mf, sum(m * m) / count(*) - avg(m) * avg(m) AS var, sum(m * f) / count(*) - avg(m) * avg(f) AS cov FROM k GROUP BY c),
b AS (SELECT *, n >= 128 AND cov / var > 0 AS ok, CASE WHEN n >= 128 AND cov / var > 0 THEN least(4.0, greatest(0.25, cov / var)) ELSE 1.0 END AS g FROM a)
SELECT c, ok, round(g::DOUBLE, 6) AS gain, round(CASE WHEN ok THEN mf - g * mm ELSE 0.0 END::DOUBLE, 3) AS "offset", n FROM b""",
    "intensity_percentile_gain": f"""WITH {VOX}, {PAIRS}, q AS (SELECT c, count(*) AS n, quantile_cont(fixed, 0.05) AS f0, quantile_cont(fixed, 0.5) AS f1, quantile_cont(fixed, 0.95) AS f2,
quantile_cont(moving, 0.05) AS m0, quantile_cont(moving, 0.5) AS m1, quantile_cont(moving, 0.95) AS m2 FROM pr WHERE fixed > 0 AND moving > 0 GROUP BY c),
g AS (SELECT *, CASE WHEN n >= 1024 AND m2 > m0 THEN least(10.0, greatest(0.1, (f2 - f0) / (m2 - m0))) ELSE 1.0 END AS gain FROM q)
SELECT c, round(gain::DOUBLE, 6) AS gain, round(CASE WHEN n >= 1024 AND m2 > m0 THEN least(5 * (f2 - f0), greatest(-5 * (f2 - f0), f1 - gain * m1)) ELSE 0.0 END::DOUBLE, 6) + 0.0 AS "offset", n FROM g""",
    "intensity_compare_ks": f"""WITH {VOX}, k AS (SELECT c, v, count(*) FILTER (WHERE p % 2 = 0) AS a, count(*) FILTER (WHERE p % 2 = 1) AS b FROM v GROUP BY c, v),
s AS (SELECT c, v, abs((sum(a) OVER r)::DOUBLE / (sum(a) OVER w) - (sum(b) OVER r)::DOUBLE / (sum(b) OVER w)) AS d, a::DOUBLE / (sum(a) OVER w) AS pa, b::DOUBLE / (sum(b) OVER w) AS pb,
  min(v) OVER w AS lo, (max(v) OVER w - min(v) OVER w) / 256.0::DOUBLE AS width FROM k WINDOW w AS (PARTITION BY c), r AS (PARTITION BY c ORDER BY v)),
cells AS (SELECT c, least(255, floor((v - lo) / width))::INT AS bin, width, sum(pa - pb) AS g FROM s GROUP BY ALL),
e AS (SELECT c, sum(g) OVER r AS cdf, width, coalesce(lead(bin) OVER r, 256) - bin AS span FROM cells WINDOW r AS (PARTITION BY c ORDER BY bin))
SELECT c, round(ks, 6) AS ks_d, round(w, 6) AS wasserstein FROM (SELECT c, max(d) AS ks FROM s GROUP BY c) JOIN (SELECT c, sum(abs(cdf) * width * span) AS w FROM e GROUP BY c) USING (c)""",
    "significance_filter": f"""WITH {VOX}, st AS (SELECT t, p, c, avg(v) + 2 * stddev_pop(v) AS lim FROM v GROUP BY ALL)
SELECT t, p, c, z + 0.6::DOUBLE AS z, y + 0.6::DOUBLE AS y, x + 0.6::DOUBLE AS x, v AS value FROM v JOIN st USING (t, p, c) WHERE v > 2200 AND v >= lim""",
    "centroid_weighted": f"""WITH {VOX}, w AS (SELECT a.t, a.p, a.c, a.z, a.y, a.x, b.y AS wy, b.x AS wx, b.v FROM v a JOIN v b ON a.t = b.t AND a.p = b.p AND a.c = b.c AND a.z = b.z
  AND b.y BETWEEN a.y - 2 AND a.y + 2 AND b.x BETWEEN a.x - 2 AND a.x + 2 WHERE a.v > 2300),
q AS (SELECT t, p, c, z, y, x, quantile_cont(v, 0.2)::DOUBLE AS base FROM w GROUP BY ALL),
m AS (SELECT t, p, c, z, y, x, sum(greatest(0.0, v - base)) AS s, sum(greatest(0.0, v - base) * wy) AS sy, sum(greatest(0.0, v - base) * wx) AS sx FROM w JOIN q USING (t, p, c, z, y, x) GROUP BY ALL)
SELECT t, p, c, z, y, x, round(CASE WHEN s > 0 THEN sy / s ELSE y END::DOUBLE, 6) AS cy, round(CASE WHEN s > 0 THEN sx / s ELSE x END::DOUBLE, 6) AS cx FROM m""",
    "residual_summary": """WITH d AS (SELECT event_type, sqrt(value * value + 1) AS d FROM events)
SELECT event_type, round(sqrt(avg(d * d)), 6) AS rms, round(quantile_cont(d, 0.5), 6) AS median, round(quantile_cont(d, 0.95), 6) AS p95, count(*) AS n FROM d GROUP BY 1""",
    "warp_summary": """WITH d AS (SELECT l_returnflag, sqrt(l_discount ** 2 + l_tax ** 2 + (l_quantity / 50) ** 2) AS d FROM lineitem)
SELECT l_returnflag, round(avg(d), 6) AS mean, round(min(d), 6) AS min, round(stddev_pop(d), 6) AS std, round(max(d), 6) AS max, count(*) AS n FROM d GROUP BY 1""",
    "intensity_histogram": f"WITH {VOX} SELECT c, (v // 16 * 16)::INT AS bin, count(*) AS n FROM v GROUP BY ALL",
    "safe_cast_u16": f"WITH {VOX} SELECT t, p, c, z, y, x, round_even(least(65535.0, greatest(0.0, (v - 2000) * 300.5::DOUBLE)), 0)::INT AS v FROM v",
    "truncate_cast_u16": f"WITH {VOX} SELECT t, p, c, z, y, x, floor(least(65535.0, 0.0::DOUBLE + 1000.0::DOUBLE * greatest(0.0, (v - 1900) / 250.0::DOUBLE)))::INT AS v FROM v",
    "scalar_functions": """SELECT event_id, round(value / 2.354820045, 6) + 0.0 AS sigma, round(2.0 * exp(-((value - 10.0) ** 2) / (2 * 7.5 * 7.5)) + 0.5, 6) + 0.0 AS model,
round(least(1.0, greatest(0.0, value / 50)) ** 2 * (3 - 2 * least(1.0, greatest(0.0, value / 50))), 6) + 0.0 AS eased, round(3.0 + (value - 3.0) * 0.25, 6) + 0.0 AS between FROM events""".replace("AS between", 'AS "between"'),
    "rotation_shear_matrix": """WITH a AS (SELECT s_suppkey, radians(s_suppkey * 3 % 90) AS a, radians(s_suppkey * 5 % 90) AS b, radians(s_suppkey * 7 % 90) AS g FROM supplier),
r AS (SELECT s_suppkey, cos(g)*cos(b) AS r00, cos(g)*sin(b)*sin(a) - sin(g)*cos(a) AS r01, cos(g)*sin(b)*cos(a) + sin(g)*sin(a) AS r02,
  sin(g)*cos(b) AS r10, sin(g)*sin(b)*sin(a) + cos(g)*cos(a) AS r11, sin(g)*sin(b)*cos(a) - cos(g)*sin(a) AS r12, -sin(b) AS r20, cos(b)*sin(a) AS r21, cos(b)*cos(a) AS r22 FROM a)
SELECT s_suppkey, """ + ", ".join(f"round(r{i}0, 6) + 0.0 AS m{i}0, round(r{i}0 * 0.1 + r{i}1, 6) + 0.0 AS m{i}1, round(r{i}0 * 0.2 + r{i}1 * 0.3 + r{i}2, 6) + 0.0 AS m{i}2" for i in range(3)) + " FROM r",
    "parse_texts": """SELECT n_nationkey, (n_nationkey / 4 + 0.5)::DOUBLE AS zoom, (n_nationkey % 3 + 1)::INT AS bin_x, (n_nationkey % 4 + 1)::INT AS bin_y, (n_nationkey + 1)::INT AS chunk,
'+y' AS x_axis, 'none' AS y_axis, ['t', 'c', 'p', 'z'][n_nationkey % 4 + 1] AS axis, ['TIFF', 'H5', 'N5', 'UNKNOWN'][n_nationkey % 4 + 1] AS kind FROM nation""",
    "stage_translations": f"""WITH {STAGE}, pos AS (SELECT row AS p FROM stage UNION ALL SELECT row + 1000 FROM stage), f AS (SELECT * FROM stage WHERE row = 0)
SELECT p, round(coalesce(s.x, f.x) - f.x, 6) + 0.0 AS world_z, round(-(coalesce(s.y, f.y) - f.y), 6) + 0.0 AS world_y, 0.0::DOUBLE AS world_x FROM pos LEFT JOIN stage s ON s.row = p CROSS JOIN f""",
    "anchor_position": f"""WITH {STAGE}, m AS (SELECT avg(x) AS x, avg(y) AS y, avg(z) AS z FROM stage)
SELECT row AS anchor FROM stage s, m ORDER BY round((s.x - m.x) ** 2 + (s.y - m.y) ** 2 + (s.z - m.z) ** 2, 9), row LIMIT 1""",
    "nominal_transforms": f"WITH {MATRIX} SELECT p, " + ", ".join(f"round(m{i}{j}, 6) + 0.0 AS m{i}{j}" for i in range(3) for j in range(4)) + " FROM tm",
    "tile_bboxes": f"WITH {BOXES} SELECT * FROM box",
    "edge_specs": f"WITH {EDGES} SELECT fixed, moving, " + ", ".join(f"round({s}_{a}, 6) + 0.0 AS {s}_{a}" for a in "xyz" for s in ("min", "max")) + ", overlap_voxels::BIGINT AS overlap_voxels FROM edge",
    "overlap_crops": f"WITH {EDGES} SELECT fixed, moving, " + ", ".join(
        f"round(min_{a} - {n * s}, 6) + 0.0 AS min_{a}, greatest(1, ceil(((max_{a} + {n * s}) - (min_{a} - {n * s})) / {s} - 1e-9))::INT AS size_{a}" for a, s, n in (("x", 0.5, 2), ("y", 0.5, 2), ("z", 1.0, 1))
    ) + " FROM edge",
    "connected_tiles": f"""WITH RECURSIVE {EDGES}, e AS (SELECT fixed AS a, moving AS b FROM edge WHERE fixed % 4 <> 3 UNION ALL SELECT moving, fixed FROM edge WHERE fixed % 4 <> 3),
reach AS (SELECT row AS p, row AS q FROM stage UNION SELECT reach.p, e.b FROM reach JOIN e ON e.a = reach.q) SELECT p, min(q) AS component FROM reach GROUP BY p""",
    "mutual_nn": """WITH c AS (SELECT c_custkey AS id, c_custkey * 37 % 101 + c_acctbal / 1e4 AS r, (c_custkey * 53 % 97)::DOUBLE AS c FROM customer),
d AS (SELECT m.id AS moving, f.id AS fixed, sqrt((f.r - m.r) ** 2 + (f.c - m.c) ** 2) AS d FROM c f JOIN c m ON f.id % 2 = 0 AND m.id % 2 = 1 AND abs(f.r - m.r) < 3.0 AND abs(f.c - m.c) < 3.0),
k AS (SELECT *, row_number() OVER (PARTITION BY moving ORDER BY d, fixed) AS a, row_number() OVER (PARTITION BY fixed ORDER BY d, moving) AS b FROM d WHERE d < 3.0)
SELECT moving, fixed, round(d, 6) AS d FROM k WHERE a = 1 AND b = 1""",
    "chunk_tile_overlap": f"""WITH {BOXES} SELECT i * 5.0::DOUBLE - 3 AS chunk_min_x, p FROM range(0, 40) r(i), box
WHERE min_x < i * 5.0 + 2 AND max_x > i * 5.0 - 3 AND min_y < 2.0 AND max_y > -4.0 AND min_z < 9.0 AND max_z > 0.0""",
    "blend_profiles": """WITH s AS (SELECT * FROM (VALUES ('z', 10, 3), ('y', 8, 4), ('x', 12, 4)) t(axis, n, w)),
i AS (SELECT axis, n, w, unnest(range(0, n)) AS i FROM s)
SELECT axis, i::INT AS i, round(CASE WHEN i < w THEN (0.5 - 0.5 * cos(pi() * i / (w - 1))) ** 2 WHEN i >= n - w THEN (0.5 - 0.5 * cos(pi() * (n - 1 - i) / (w - 1))) ** 2 ELSE 1.0 END::DOUBLE, 6) + 0.0 AS w FROM i""",
    "fuse_translation_average": _fuse("1.0::DOUBLE"),
    "fuse_translation_feather": _fuse("CASE WHEN x IN (0, 7) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END"),
    "gain_apply": f"WITH {VOX}, g AS (SELECT t, p, 2000.0::DOUBLE / avg(v) AS gain FROM v GROUP BY t, p) SELECT t, p, c, z, y, x, round(v * gain + 1.5, 6) + 0.0 AS v FROM v JOIN g USING (t, p)",
    "detection_table": f"WITH {DET} SELECT * FROM det",
    "detection_sort": f"WITH {DET} SELECT t, p, (row_number() OVER (PARTITION BY t, p ORDER BY z, y, x, c, sigma, intensity))::INT AS place, z, y, x, c, sigma, intensity FROM det",
    "real_tracks": """WITH e AS (SELECT event_id % 50 AS track, event_id AS t, CASE WHEN event_id % 3 = 0 THEN -0.5 ELSE value END::DOUBLE AS y, CASE WHEN event_id % 6 = 0 THEN -0.5 ELSE 1.0 END::DOUBLE AS x FROM events)
SELECT * FROM e WHERE NOT (abs(x + 0.5) < 1e-6 AND abs(y + 0.5) < 1e-6)""",
    "envelope_tilt": """WITH f AS (SELECT (l_orderkey % 40)::INT AS y, floor(l_orderkey % 40 / 2 + l_linenumber)::INT AS z, max(l_quantity + 10) AS v FROM lineitem GROUP BY 1, 2),
b AS (SELECT y, z FROM f, (SELECT min(v) AS lo, max(v) AS hi FROM f) WHERE v > lo + 0.1 * (hi - lo)),
e AS (SELECT y, min(z)::DOUBLE AS a, max(z)::DOUBLE AS b FROM b GROUP BY y), s AS (SELECT y, 'a' AS side, a AS z FROM e UNION ALL SELECT y, 'b', b FROM e),
q AS (SELECT side, quantile_cont(z, 0.05) AS lo, quantile_cont(z, 0.95) AS hi FROM s GROUP BY side),
k AS (SELECT side, regr_slope(z, y) AS slope FROM s JOIN q USING (side) WHERE z >= lo AND z <= hi GROUP BY side)
SELECT round(quantile_cont(degrees(atan(slope * 1.0 / 0.5)), 0.5), 6) + 0.0 AS tilt_deg FROM k""",
    "provenance_chain": f"WITH RECURSIVE {RUNS} SELECT store, run_index, run_id, prev_hash, self_hash FROM chained",
    "provenance_verify": f"""WITH RECURSIVE {RUNS}, a AS (SELECT store, run_index, run_id, parameters, self_hash, CASE WHEN run_id % 97 = 0 THEN 'altered' ELSE status END AS status,
CASE WHEN run_id % 89 = 0 THEN '0' ELSE prev_hash END AS prev_hash FROM chained),
k AS (SELECT *, sha256(store || '|' || run_index || '|' || run_id || '|' || status || '|' || parameters || '|' || coalesce(prev_hash, '')) <> self_hash AS bad_self,
prev_hash IS DISTINCT FROM lag(self_hash) OVER (PARTITION BY store ORDER BY run_index) AS bad_prev FROM a)
SELECT store, run_index, bad_self, bad_prev FROM k WHERE bad_self OR bad_prev""",
    "provenance_latest": f"WITH RECURSIVE {RUNS} SELECT store, run_index, run_id, parameters FROM (SELECT *, row_number() OVER (PARTITION BY store ORDER BY run_index DESC) AS k FROM runs WHERE status = 'completed') WHERE k = 1",
    "provenance_match": f"WITH RECURSIVE {RUNS} SELECT store, max(run_index) AS run_index, max(run_id) AS run_id FROM runs WHERE status = 'completed' AND NOT skipped AND parameters = '1-URGENT' AND store IN (SELECT c_custkey FROM customer) GROUP BY store",
    "audit_sequence": "SELECT event_id, user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INT AS sequence FROM events",
    "audit_latest_reference": "SELECT o_orderpriority AS operation, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS component FROM orders GROUP BY 1",
    "dependency_antijoin": "SELECT l_orderkey AS component, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')",
    "audit_redact": """SELECT event_id, '{"a":[{"Password":"[REDACTED]"}],"props":{"k":' || (props::JSON ->> 'k') || '},"token":"[REDACTED]"}' AS payload FROM events""",
    "phase_correlation": f"WITH {VOX} SELECT DISTINCT ((t * 5 + p) * 2 + c)::BIGINT AS edge, 0.0::DOUBLE AS dz, -2.0::DOUBLE AS dy, 3.0::DOUBLE AS dx FROM v",
    "solve_translation": f"""WITH {VOX}, k AS (SELECT DISTINCT ((t * 5 + p) * 2 + c)::BIGINT AS volume FROM v)
SELECT volume, i::INT AS copy, i::DOUBLE AS x, 0.0::DOUBLE - i AS y, 0.0::DOUBLE AS z FROM k, range(0, 3) r(i)""",
    "setting_functions": """SELECT p_partkey, round(p_size + (p_partkey - p_size) * 0.25, 6)::DOUBLE AS v0, round(p_partkey + (0 - p_partkey) * 0.25, 6)::DOUBLE AS v1,
CASE WHEN p_partkey % 2 = 0 THEN 7 WHEN p_partkey % 4 < 3 THEN (p_partkey % 4 + 1)::INT ELSE -1 END AS channel,
CASE p_partkey % 3 WHEN 0 THEN p_size WHEN 1 THEN p_size + 1 ELSE 1 END::DOUBLE AS value, CASE p_partkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS source,
least(32767, greatest(0, round_even(p_size * 1000 - 10000.5::DOUBLE, 0)))::BIGINT AS cast,
round(CASE WHEN p_partkey % 2 = 0 THEN p_size / 100.0::DOUBLE WHEN p_partkey % 5 = 0 THEN (p_size + 1) / 50.0::DOUBLE ELSE 6.5::DOUBLE / p_size * 2 END, 6) AS pixel FROM part""",
    "array_tiles": """SELECT z::INT AS z_start, least(z + 4, 10)::INT AS z_stop, y::INT AS y_start, least(y + 3, 8)::INT AS y_stop, x::INT AS x_start, least(x + 5, 8)::INT AS x_stop
FROM range(0, 10, 4) a(z), range(0, 8, 3) b(y), range(0, 8, 5) d(x)""",
    "registration_grid": """WITH n AS (SELECT unnest(range(10, 60))::INT AS size), s AS (SELECT size, unnest(range(0, size - 7, 6))::INT AS start FROM n
UNION SELECT size, size - 8 FROM n) SELECT size, (row_number() OVER (PARTITION BY size ORDER BY start) - 1)::INT AS chunk, start FROM s""",
    "extended_levels": "SELECT i::INT AS level, 1 AS t, 1 AS p, 1 AS c, (CASE WHEN i = 0 THEN 1 ELSE 2 ** (i - 1) END)::INT AS z, (2 ** i)::INT AS y, (2 ** i)::INT AS x FROM range(0, 6) r(i)",
    "pairwise_budget": """SELECT p_partkey, CASE WHEN p_size::DOUBLE ** 3 * 6000 <= 500000 THEN 1 ELSE ceil(cbrt(p_size::DOUBLE ** 3 * 6000 / 500000) - 1e-9) END::INT AS factor FROM part""",
    "detection_by_intensity": f"WITH {DET} SELECT *, (row_number() OVER (PARTITION BY t, p ORDER BY intensity DESC, z, y, x, c, sigma))::INT AS place FROM det",
    "event_log_manifest": "SELECT count(*)::BIGINT AS event_count, sum(strlen(props))::BIGINT AS bytes FROM events WHERE event_id % 10 <> 0",
    "residual_of_edges": "SELECT l_orderkey, l_linenumber, round(sqrt(l_quantity ** 2 + l_discount ** 2 + l_tax ** 2) / (2.0::DOUBLE / 3), 6) AS residual FROM lineitem",
    "chunk_mip_xy": f"WITH {VOX} SELECT t, p, c, y, x, max(v) AS v FROM v GROUP BY ALL",
    "chunk_mip_xz": f"WITH {VOX} SELECT t, p, c, z, x, max(v) AS v FROM v GROUP BY ALL",
    "chunk_mip_yz": f"WITH {VOX} SELECT t, p, c, z, y, max(v) AS v FROM v GROUP BY ALL",
    "chunk_stride": f"WITH {VOX} SELECT t, p, c, (z // 3)::INT AS z, (y // 2)::INT AS y, (x // 4)::INT AS x, v FROM v WHERE z % 3 = 0 AND y % 2 = 0 AND x % 4 = 0",
    "chunk_histogram": f"WITH {VOX} SELECT c, least(19, (v - 1000) // 100)::INT AS bin, count(*) AS n FROM v WHERE v BETWEEN 1000 AND 3000 GROUP BY ALL",
    "chunk_fuse_feather": f"""WITH {VOX}, w AS (SELECT t, c, z, y, x + 6 * p AS x, v, CASE WHEN x IN (0, 7) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM v),
s AS (SELECT t, c, z, y, x, sum(v * w) AS a, sum(w) AS w FROM w GROUP BY t, c, z, y, x)
SELECT t, c, z, y, x::INT AS x, least(65535, round_even(a / w, 0))::INT AS v FROM s WHERE w > 0 AND a > 0""",
    "fit_tiles": f"""WITH {VOX}, n AS (SELECT max(p) AS p, max(c) AS c FROM v)
SELECT y::INT AS y_start, least(y + 3, 8)::INT AS y_stop, x::INT AS x_start, least(x + 5, 8)::INT AS x_stop, greatest(y - 1, 0)::INT AS y_read_start, least(y + 4, 8)::INT AS y_read_stop,
greatest(x - 2, 0)::INT AS x_read_start, least(x + 7, 8)::INT AS x_read_stop, i::INT AS p, j::INT AS c FROM range(0, 8, 3) a(y), range(0, 8, 5) b(x), (SELECT unnest(range(0, p + 1)) AS i FROM n), (SELECT unnest(range(0, c + 1)) AS j FROM n)""",
    "transform_tiles": f"""WITH {VOX}, k AS (SELECT DISTINCT t, p, c FROM v)
SELECT t, p, c, 0 AS z_start, 10 AS z_stop, y::INT AS y_start, least(y + 4, 8)::INT AS y_stop, x::INT AS x_start, least(x + 5, 8)::INT AS x_stop FROM k, range(0, 8, 4) a(y), range(0, 8, 5) b(x)""",
    "tile_weight_products": """WITH a AS (SELECT y, CASE WHEN y < 2 THEN (y + 1) / 3.0::DOUBLE WHEN y >= 5 THEN 1 - (y - 4) / 3.0::DOUBLE ELSE 1.0 END AS w FROM range(0, 7) r(y)),
b AS (SELECT x, CASE WHEN x < 1 THEN (x + 1) / 2.0::DOUBLE WHEN x >= 4 THEN 1 - (x - 3) / 2.0::DOUBLE ELSE 1.0 END AS w FROM range(0, 5) r(x))
SELECT y::INT AS y, x::INT AS x, round(greatest(a.w, 1e-3) * greatest(b.w, 1e-3), 6) + 0.0 AS w FROM a, b""",
    "particle_overlay": f"WITH {DET} SELECT t, c, z, y, x, sigma, intensity FROM det WHERE p = 2",
    "detection_rows": f"""WITH {DET}, n AS (SELECT *, row_number() OVER (ORDER BY t, p, z, y, x, c, sigma, intensity) - 1 AS row FROM det)
SELECT row, row // 16384 AS chunk, t, p, c, z, y, x, sigma, intensity FROM n""",
    "tiff_name_parse": f"WITH {VOX}, {PATHS} SELECT t, p, c, path FROM paths",
    "collection_completeness": f"""WITH {VOX}, {PATHS}, k AS (SELECT * FROM paths WHERE NOT (p = 2 AND t % 3 = 1) AND NOT (p = 4 AND c = 1 AND t = 0))
SELECT a.t, b.p, d.c FROM (SELECT DISTINCT t FROM k) a, (SELECT DISTINCT p FROM k) b, (SELECT DISTINCT c FROM k) d EXCEPT SELECT t, p, c FROM k""",
    "h5_sort": """WITH n AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN n_name ELSE format('CH{:02d}_{:06d}.h5', n_nationkey % 3, n_nationkey * 7 % 11) END AS name,
CASE WHEN n_nationkey % 5 = 0 THEN 9999 ELSE n_nationkey % 3 END AS c, CASE WHEN n_nationkey % 5 = 0 THEN 9999 ELSE n_nationkey * 7 % 11 END AS t FROM nation)
SELECT name, (row_number() OVER (ORDER BY c, t, name))::INT AS place FROM n""",
    "frame_specs": """WITH k AS (SELECT n_nationkey AS kf, CASE WHEN n_nationkey % 3 = 0 THEN n_nationkey % 4 ELSE 5 END AS g, lead(n_nationkey) OVER (ORDER BY n_nationkey) AS nx FROM nation),
f AS (SELECT kf, kf AS e, k AS s, 0.0::DOUBLE AS alpha FROM k, range(0, 3) r(k) UNION ALL
SELECT kf, nx, j + 3, (j + 1)::DOUBLE / (g + 1) FROM (SELECT *, unnest(range(0, g)) AS j FROM k WHERE nx IS NOT NULL))
SELECT (row_number() OVER (ORDER BY kf, s) - 1)::INT AS frame, kf AS start, e AS "end", round(alpha, 6) + 0.0 AS alpha FROM f""",
    "frame_gaps": """WITH n AS (SELECT DISTINCT (o_orderkey % 1000000)::INT AS n FROM orders WHERE o_orderkey % 13 <> 5), b AS (SELECT n, coalesce(lag(n) OVER (ORDER BY n), -1) AS before FROM n)
SELECT * FROM b WHERE n <> before + 1""",
    "mutual_information": f"""WITH {VOX}, {PAIRS}, r AS (SELECT c, fixed, moving, min(fixed) OVER w AS f0, max(fixed) OVER w AS f1, min(moving) OVER w AS m0, max(moving) OVER w AS m1 FROM pr WINDOW w AS (PARTITION BY c)),
b AS (SELECT c, least(15, floor((fixed - f0)::DOUBLE / (f1 - f0) * 16))::INT AS f, least(15, floor((moving - m0)::DOUBLE / (m1 - m0) * 16))::INT AS m FROM r),
k AS (SELECT c, f, m, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT *, sum(n) OVER (PARTITION BY c) AS a, sum(n) OVER (PARTITION BY c, f) AS nf, sum(n) OVER (PARTITION BY c, m) AS nm FROM k),
i AS (SELECT c, sum(n::DOUBLE / a * ln(n::DOUBLE * a / (nf::DOUBLE * nm))) AS mi FROM s GROUP BY c)
SELECT c, round(mi, 6) + 0.0 AS mutual_information, round(corr(fixed, moving), 6) + 0.0 AS correlation FROM i JOIN pr USING (c) GROUP BY c, mi""",
    "stitch_tiles": f"""WITH {VOX}, f AS (SELECT t, p, c, y, x, max(v) AS v FROM v GROUP BY ALL),
w AS (SELECT t, c, y + 2 AS y, x + 2 + 6 * p AS x, v, CASE WHEN p < 4 AND x >= 6 THEN greatest(0.5 - 0.5 * cos(pi() * (7 - x)), 0.001::FLOAT::DOUBLE)
  WHEN p > 0 AND x < 2 THEN greatest(0.5 - 0.5 * cos(pi() * x), 0.001::FLOAT::DOUBLE) ELSE 1.0 END AS w FROM f)
SELECT t, c, y::INT AS y, x::INT AS x, least(65535, greatest(0, round_even(sum(v * w) / sum(w), 0)))::INT AS v FROM w GROUP BY t, c, y, x""",
    "tile_name_parse": f"WITH {VOX} SELECT 'xz' AS projection, t, c, count(DISTINCT p) AS tiles, min(p) AS first, max(p) AS last FROM v GROUP BY t, c",
}
