"""Queries: background, motion, masks, pixel filters and tiles (FRM22-37, TIL1-4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import frames
from footlamp.catalog.frames import ENH, FR, canny, enhanced, nb, px, rounded
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.kernels import ellipse, gaussian_kernel
from footlamp.functions.scalars import r6
from footlamp.operators import filters as O

THR = 0.3
K1 = "asset_id, frame_no"


def offsets(size: int) -> list[tuple[int, int]]:
    r = size // 2
    k = ellipse(size)
    return [(i - r, j - r) for i in range(size) for j in range(size) if k[i][j]]


def near(dy: int, dx: int, outside: str) -> str:
    return f"coalesce(CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN B[(y + {dy}) * 8 + x + {dx} + 1] END, {outside})"


def morph(src: str, out: str, size: int, op: str) -> str:
    """Dilate or erode the packed mask B of ``src``."""
    glue, outside = (" OR ", "false") if op == "dilate" else (" AND ", "true")
    cond = glue.join(near(dy, dx, outside) for dy, dx in offsets(size))
    return f"{px(src, out + '_x')}, {out} AS (SELECT {K1}, list({cond} ORDER BY i) AS B FROM (SELECT {K1}, y, x, i, B FROM {out}_x) GROUP BY {K1})".replace(f"{px(src, out + '_x')}", mask_px(src, out + "_x"))


def mask_px(src: str, name: str) -> str:
    return f"{name} AS (SELECT {K1}, B, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, i FROM {src}, (SELECT unnest(range(64)) AS i) g)"


def chain(src: str, out: str, steps: list[tuple[int, str]]) -> str:
    parts, cur = [], src
    for n, (size, op) in enumerate(steps):
        nxt = out if n == len(steps) - 1 else f"{out}_{n}"
        parts.append(morph(cur, nxt, size, op))
        cur = nxt
    return ", ".join(parts)


MOTION_STEPS = [(3, "erode"), (3, "dilate"), (3, "dilate"), (3, "erode"), (3, "dilate")]


def motion_sql(prev: str, out: str, thr: float = THR) -> str:
    """Motion mask of fr against an earlier frame list; no earlier frame gives no motion."""
    raw = f"{out}_r AS (SELECT {K1}, list_transform(range(64), lambda i: coalesce(abs(L[i + 1] - {prev}[i + 1]) / 255e0 > {thr}e0, false)) AS B FROM fl)"
    return f"{raw}, {chain(out + '_r', out, MOTION_STEPS)}"


FL = f"{FR}, fl AS (SELECT *, lag(L) OVER w AS P, lag(L, 2) OVER w AS Q FROM fr WINDOW w AS (PARTITION BY asset_id ORDER BY frame_no))"


def unpack(name: str = "B", alias: str = "v") -> str:
    return f"CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, {name}[i + 1] AS {alias}"


GRID = "(SELECT unnest(range(64)) AS i) g"


def to_pixels(df, col="luma", alias="v"):
    """Packed result as pixel rows."""
    e = df.select("asset_id", "frame_no", "w", F.posexplode(col).alias("p", alias))
    return e.select("asset_id", "frame_no", F.floor(F.col("p") / F.col("w")).cast("int").alias("y"), (F.col("p") % F.col("w")).cast("int").alias("x"), alias)


def kern(kernel, arr="L") -> str:
    r = len(kernel) // 2
    return " + ".join(f"({float(k)!r}::DOUBLE) * {nb(i - r, j - r, arr)}" for i, row in enumerate(kernel) for j, k in enumerate(row))


SOFT3 = kern(gaussian_kernel(3, 0.5).tolist())
BACK = f"""{px('fr', 'bp')}, bb AS (SELECT asset_id, i, floor({SOFT3} + 0.5e0) AS v FROM bp), bg AS (SELECT asset_id, i, CAST(floor(quantile_cont(v, 0.5)) AS INT) AS background FROM bb GROUP BY asset_id, i)"""


@query("frm22_background_model", f"WITH {FR}, {BACK} SELECT asset_id, CAST(i AS INT) AS p, background FROM bg")
def frm22(t):
    return O.background_model(frames(t)).select("asset_id", F.posexplode("background").alias("p", "background"))


@query("frm23_motion_mask", f"WITH {FL}, {motion_sql('P', 'm')} SELECT {K1}, {unpack()} FROM m, {GRID}")
def frm23(t):
    return to_pixels(O.motion_mask(frames(t), THR), "motion")


MULTI = f"""{FL}, {motion_sql('P', 'm1')}, {motion_sql('Q', 'm2')}, mo AS (SELECT a.asset_id, a.frame_no, list_transform(range(64), lambda i: a.B[i + 1] OR b.B[i + 1]) AS B
  FROM m1 a JOIN m2 b ON a.asset_id = b.asset_id AND a.frame_no = b.frame_no), {chain('mo', 'mc', [(5, 'dilate'), (5, 'erode')])},
mm AS (SELECT mc.asset_id, mc.frame_no, CASE WHEN mc.frame_no >= 2 THEN mc.B ELSE m1.B END AS B FROM mc JOIN m1 ON mc.asset_id = m1.asset_id AND mc.frame_no = m1.frame_no)"""


@query("frm24_motion_mask_multi", f"WITH {MULTI} SELECT {K1}, {unpack()} FROM mm, {GRID}")
def frm24(t):
    return to_pixels(O.motion_mask_multi(frames(t), THR), "motion")


@query(
    "frm25_background_lock",
    f"""WITH {MULTI}, {chain('mm', 'wide', [(7, 'dilate'), (7, 'dilate')])}, {BACK}
    SELECT wide.asset_id, wide.frame_no, CAST(g.i // 8 AS INT) AS y, CAST(g.i % 8 AS INT) AS x, CASE WHEN wide.B[g.i + 1] THEN fr.L[g.i + 1] ELSE bg.background END AS v
    FROM wide JOIN fr ON fr.asset_id = wide.asset_id AND fr.frame_no = wide.frame_no, {GRID}, bg WHERE bg.asset_id = wide.asset_id AND bg.i = g.i""".replace(
        f"{THR}e0", "0.5e0"
    ),
)
def frm25(t):
    f = frames(t)
    return to_pixels(O.background_lock(f, O.background_model(f), 0.5))


@query(
    "frm26_temporal_smooth",
    f"""WITH {FL}, {motion_sql('P', 'm')} SELECT m.asset_id, m.frame_no, CAST(g.i // 8 AS INT) AS y, CAST(g.i % 8 AS INT) AS x,
    CAST(CASE WHEN P IS NULL OR B[g.i + 1] THEN L[g.i + 1] ELSE floor((1 - 0.1e0) * L[g.i + 1] + 0.1e0 * P[g.i + 1] + 1e-6) END AS INT) AS v
    FROM m JOIN fl ON fl.asset_id = m.asset_id AND fl.frame_no = m.frame_no, {GRID}""",
)
def frm26(t):
    return to_pixels(O.temporal_smooth(frames(t), "high", THR))


@query(
    "frm27_temporal_fir",
    f"""WITH {FR}, n AS (SELECT *, lag(L) OVER w AS P, lead(L) OVER w AS X FROM fr WINDOW w AS (PARTITION BY asset_id ORDER BY frame_no))
    SELECT {K1}, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
      CAST(CASE WHEN P IS NULL OR X IS NULL THEN L[i + 1] ELSE floor(0.15e0 * P[i + 1] + 0.7e0 * L[i + 1] + 0.15e0 * X[i + 1] + 1e-6) END AS INT) AS v FROM n, {GRID}""",
)
def frm27(t):
    return to_pixels(O.temporal_fir(frames(t)))


@query(
    "frm27_temporal_in_place",
    f"""WITH RECURSIVE {FR}, n AS MATERIALIZED (SELECT *, lead(L) OVER w AS X FROM fr WINDOW w AS (PARTITION BY asset_id ORDER BY frame_no)),
    r AS (SELECT asset_id, frame_no, L AS S FROM n WHERE frame_no = 0
      UNION ALL SELECT n.asset_id, n.frame_no, CASE WHEN X IS NULL THEN L ELSE list_transform(range(64), lambda i: CAST(floor(0.15e0 * r.S[i + 1] + 0.7e0 * L[i + 1] + 0.15e0 * X[i + 1] + 1e-6) AS INT)) END
      FROM r JOIN n ON n.asset_id = r.asset_id AND n.frame_no = r.frame_no + 1)
    SELECT {K1}, {unpack('S')} FROM r, {GRID}""",
)
def frm27_in_place(t):
    return to_pixels(O.temporal_in_place(frames(t), chunk=32))


@query(
    "frm28_block_motion",
    f"""WITH {FL}, b AS (SELECT {K1}, L, P, bi, dy, dx FROM fl, (SELECT unnest(range(4)) AS bi) q, (SELECT unnest(range(-2, 3)) AS dy) a, (SELECT unnest(range(-2, 3)) AS dx) c WHERE P IS NOT NULL),
    v AS (SELECT *, bi // 2 * 4 AS y0, bi % 2 * 4 AS x0 FROM b WHERE bi // 2 * 4 + dy BETWEEN 0 AND 4 AND bi % 2 * 4 + dx BETWEEN 0 AND 4),
    s AS (SELECT {K1}, bi, dy, dx, sum(abs(L[(y0 + j // 4) * 8 + x0 + j % 4 + 1] - P[(y0 + dy + j // 4) * 8 + x0 + dx + j % 4 + 1])) AS cost FROM v, (SELECT unnest(range(16)) AS j) k GROUP BY ALL),
    w AS (SELECT {K1}, bi, dy, dx FROM s QUALIFY row_number() OVER (PARTITION BY {K1}, bi ORDER BY cost, abs(dy) + abs(dx), dy, dx) = 1),
    m AS (SELECT {K1}, bi, count(*) FILTER (WHERE abs(L[(bi // 2 * 4 + j // 4) * 8 + bi % 2 * 4 + j % 4 + 1] - P[(bi // 2 * 4 + j // 4) * 8 + bi % 2 * 4 + j % 4 + 1]) / 255e0 > {THR}e0) AS nm
      FROM fl, (SELECT unnest(range(4)) AS bi) q, (SELECT unnest(range(16)) AS j) k WHERE P IS NOT NULL GROUP BY {K1}, bi),
    f AS (SELECT w.asset_id, w.frame_no, sum(nm) / 64e0 AS ratio, median(dy::DOUBLE) FILTER (WHERE nm <= 8) AS my, median(dx::DOUBLE) FILTER (WHERE nm <= 8) AS mx,
      stddev_pop(dy) FILTER (WHERE nm <= 8) AS sy, stddev_pop(dx) FILTER (WHERE nm <= 8) AS sx FROM w JOIN m USING (asset_id, frame_no, bi) GROUP BY w.asset_id, w.frame_no)
    SELECT {K1}, {S6('ratio')} AS motion_ratio, {S6('least(2 * sy, greatest(-2 * sy, my))')} AS shift_y, {S6('least(2 * sx, greatest(-2 * sx, mx))')} AS shift_x,
      {S6('least(0.8e0, greatest(0.3e0, 0.8e0 - 0.3e0 * ratio))')} AS alpha FROM f""",
)
def frm28(t):
    return rounded(O.block_motion(frames(t), 4, 2, THR), "motion_ratio", "shift_y", "shift_x", "alpha")


def safe_sql(strength: str, out: str) -> str:
    base = "(d > 0.1e0 AND NOT hi AND NOT lo)"
    rule = {"weak": f"{base} AND mv", "medium": f"{base} OR (mv AND NOT hi)", "strong": f"{base} OR (NOT hi AND NOT lo)"}[strength]
    return f"{out} AS (SELECT {K1}, list({rule} ORDER BY i) AS B FROM sf GROUP BY {K1})"


BOX3 = " + ".join(f"CAST({nb(dy, dx, 'G')} AS INT)" for dy in (-1, 0, 1) for dx in (-1, 0, 1))
SAFE = f"""{FL}, {canny('fr', 'k')}, eg AS (SELECT fl.asset_id, fl.frame_no, L, P, list(e.y IS NOT NULL ORDER BY g.i) AS G FROM fl JOIN {GRID} ON true
  LEFT JOIN k_e e ON e.asset_id = fl.asset_id AND e.frame_no = fl.frame_no AND e.y = g.i // 8 AND e.x = g.i % 8 GROUP BY fl.asset_id, fl.frame_no, L, P),
{px('eg', 'ep')}, sf AS (SELECT {K1}, i, luma / 255e0 > 0.85e0 AS hi, luma / 255e0 < 0.15e0 AS lo, coalesce(abs(luma - P[i + 1]) / 255e0 > {THR}e0, true) AS mv, ({BOX3}) / 9e0 AS d FROM ep)"""


def safe(t, strength):
    return O.safe_mask(frames(t), strength, box=3, moving=THR)


@query(
    "frm29_safe_mask",
    f"""WITH RECURSIVE {SAFE}, {safe_sql('weak', 'a')}, {safe_sql('medium', 'b')}, {safe_sql('strong', 'c')}
    SELECT {K1}, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, a.B[i + 1] AS weak, b.B[i + 1] AS medium, c.B[i + 1] AS strong FROM a JOIN b USING ({K1}) JOIN c USING ({K1}), {GRID}""",
)
def frm29(t):
    out = None
    for strength in ("weak", "medium", "strong"):
        part = to_pixels(safe(t, strength), "mask", strength)
        out = part if out is None else out.join(part, ["asset_id", "frame_no", "y", "x"])
    return out


SMOOTHED = f"{SAFE}, {safe_sql('weak', 's0')}, {chain('s0', 'sm5', [(5, 'dilate'), (5, 'erode'), (5, 'erode'), (5, 'dilate')])}"


@query("frm30_smooth_mask", f"WITH RECURSIVE {SMOOTHED} SELECT {K1}, {unpack()} FROM sm5, {GRID}")
def frm30(t):
    return to_pixels(O.smooth_mask(safe(t, "weak")), "mask")


REGION = f"""{SAFE}, {safe_sql('weak', 's0')}, mp AS MATERIALIZED (SELECT {K1}, i FROM s0, {GRID} WHERE B[i + 1]),
re AS (SELECT {K1}, i AS src, i FROM mp UNION SELECT m.asset_id, m.frame_no, r.src, m.i FROM re r JOIN mp m ON m.asset_id = r.asset_id AND m.frame_no = r.frame_no
  AND abs(m.i // 8 - r.i // 8) <= 1 AND abs(m.i % 8 - r.i % 8) <= 1),
lb AS (SELECT {K1}, i, min(src) AS region FROM re GROUP BY {K1}, i),
rg AS (SELECT {K1}, CAST(region AS INT) AS region, CAST(min(i % 8) AS INT) AS x, CAST(min(i // 8) AS INT) AS y, CAST(max(i % 8) - min(i % 8) + 1 AS INT) AS box_w,
  CAST(max(i // 8) - min(i // 8) + 1 AS INT) AS box_h, count(*) AS area FROM lb GROUP BY {K1}, region)"""


@query(
    "frm31_mask_regions",
    f"""WITH RECURSIVE {REGION} SELECT {K1}, region, x, y, box_w, box_h, area, {S6('area / (box_w * box_h)')} AS fill, box_w <= 6 AND box_h <= 6 AND area / (box_w * box_h) >= 0.5e0 AS selected
    FROM rg WHERE box_w >= 2 AND box_h >= 2""",
)
def frm31(t):
    return rounded(O.mask_regions(safe(t, "weak"), min_side=2, max_side=6, min_fill=0.5), "fill")


@query(
    "frm32_mask_quality",
    f"""WITH RECURSIVE {REGION}, s AS (SELECT {K1}, len(list_filter(B, lambda b: b)) / 64e0 AS r FROM s0), a AS (SELECT {K1}, count(*) AS n, avg(area) AS av, max(area) AS mx, min(area) AS mn FROM rg GROUP BY {K1})
    SELECT s.asset_id, s.frame_no, {S6('r')} AS safe_ratio, coalesce(n, 0) AS n_regions, {S6('coalesce(av, 0)')} AS avg_region, coalesce(mx, 0) AS max_region, coalesce(mn, 0) AS min_region,
      CASE WHEN r < 0.05e0 THEN 'very_conservative' WHEN r < 0.15e0 THEN 'conservative' WHEN r < 0.35e0 THEN 'balanced' WHEN r < 0.6e0 THEN 'aggressive' ELSE 'very_aggressive' END AS quality
    FROM s LEFT JOIN a ON a.asset_id = s.asset_id AND a.frame_no = s.frame_no""",
)
def frm32(t):
    return rounded(O.mask_quality(safe(t, "weak")), "safe_ratio", "avg_region")


def bilateral_sql(d: int, sigma: float) -> str:
    r = d // 2
    return f"""o AS (SELECT dy, dx FROM (SELECT unnest(range(-{r}, {r} + 1)) AS dy) a, (SELECT unnest(range(-{r}, {r} + 1)) AS dx) b WHERE dy * dy + dx * dx <= {r * r}),
    n AS (SELECT {K1}, y, x, luma, dy * dy + dx * dx AS far, L[(7 - abs(7 - abs(y + dy))) * 8 + (7 - abs(7 - abs(x + dx))) + 1] AS nv FROM px, o),
    w AS (SELECT {K1}, y, x, nv, exp(-far / (2 * {sigma}e0 * {sigma}e0)) * exp(-((nv - luma) * (nv - luma)) / (2 * {sigma}e0 * {sigma}e0)) AS k FROM n)"""


def bilateral_query(level: int, d: int, sigma: float):
    @query(f"frm33_bilateral_level{level}", f"WITH {FR}, {px('fr')}, {bilateral_sql(d, sigma)} SELECT {K1}, y, x, {S6('sum(k * nv) / sum(k)')} AS v FROM w GROUP BY {K1}, y, x")
    def frm33(t):
        return rounded(to_pixels(O.bilateral(frames(t), level)), "v")


for _level, (_d, _sigma) in O.BILATERAL_LEVELS.items():
    bilateral_query(_level, _d, _sigma)


@query(
    "frm34_tone_correct",
    f"""WITH {FR}, {px('fr')}, h AS (SELECT {K1}, y // 4 AS ti, x // 4 AS tj, luma AS bin, count(*) AS c FROM px GROUP BY ALL),
    t AS (SELECT DISTINCT {K1}, ti, tj FROM h), ex AS (SELECT {K1}, ti, tj, sum(greatest(c - 1, 0)) AS e FROM h GROUP BY ALL),
    f AS (SELECT t.*, b.bin, least(coalesce(h.c, 0), 1) + e // 256 + CASE WHEN e % 256 > 0 AND b.bin % greatest(256 // (e % 256), 1) = 0 AND b.bin // greatest(256 // (e % 256), 1) < e % 256 THEN 1 ELSE 0 END AS c
      FROM t JOIN ex USING ({K1}, ti, tj) JOIN (SELECT unnest(range(256)) AS bin) b ON true
      LEFT JOIN h ON h.asset_id = t.asset_id AND h.frame_no = t.frame_no AND h.ti = t.ti AND h.tj = t.tj AND h.bin = b.bin),
    cu AS (SELECT {K1}, ti, tj, bin, least(255, floor(sum(c) OVER (PARTITION BY {K1}, ti, tj ORDER BY bin) * (255e0 / 16) + 0.5e0)) AS q FROM f),
    p AS (SELECT {K1}, y, x, luma, y / 4e0 - 0.5e0 AS fy, x / 4e0 - 0.5e0 AS fx FROM px),
    a AS (SELECT *, fy - floor(fy) AS ay, fx - floor(fx) AS ax, CAST(greatest(0, least(1, floor(fy))) AS INT) AS y0, CAST(greatest(0, least(1, floor(fy) + 1)) AS INT) AS y1,
      CAST(greatest(0, least(1, floor(fx))) AS INT) AS x0, CAST(greatest(0, least(1, floor(fx) + 1)) AS INT) AS x1 FROM p),
    j AS (SELECT a.*, c00.q AS q00, c01.q AS q01, c10.q AS q10, c11.q AS q11 FROM a
      JOIN cu c00 ON c00.asset_id = a.asset_id AND c00.frame_no = a.frame_no AND c00.ti = y0 AND c00.tj = x0 AND c00.bin = luma
      JOIN cu c01 ON c01.asset_id = a.asset_id AND c01.frame_no = a.frame_no AND c01.ti = y0 AND c01.tj = x1 AND c01.bin = luma
      JOIN cu c10 ON c10.asset_id = a.asset_id AND c10.frame_no = a.frame_no AND c10.ti = y1 AND c10.tj = x0 AND c10.bin = luma
      JOIN cu c11 ON c11.asset_id = a.asset_id AND c11.frame_no = a.frame_no AND c11.ti = y1 AND c11.tj = x1 AND c11.bin = luma)
    SELECT {K1}, y, x, CAST(floor(pow(floor((q00 * (1 - ax) + q01 * ax) * (1 - ay) + (q10 * (1 - ax) + q11 * ax) * ay + 0.5e0) / 255, 1 / 1.1e0) * 255 + 1e-6) AS INT) AS v FROM j""",
)
def frm34(t):
    return to_pixels(O.tone_correct(frames(t), tiles=2))


@query(
    "frm35_convolve",
    f"WITH {FR}, {px('fr')} SELECT {K1}, y, x, {S6(f'greatest(0, least(255, {kern(O.SHARPEN_3X3)}))')} AS v FROM px",
)
def frm35(t):
    return rounded(to_pixels(O.convolve(frames(t), O.SHARPEN_3X3)), "v")


@query(
    "frm35_unsharp",
    f"""WITH {FR}, {px('fr')}, g AS (SELECT {K1}, y, x, luma, {kern(gaussian_kernel(7, 1.0).tolist())} AS s FROM px)
    SELECT {K1}, y, x, {S6('greatest(0, least(255, 0.7e0 * luma + 0.3e0 * greatest(0, least(255, 1.5e0 * luma - 0.5e0 * s))))')} AS v FROM g""",
)
def frm35_unsharp(t):
    return rounded(to_pixels(O.unsharp(frames(t))), "v")


CUBIC = "CASE WHEN d <= 1 THEN 1.25e0 * d * d * d - 2.25e0 * d * d + 1 WHEN d < 2 THEN -0.75e0 * d * d * d + 3.75e0 * d * d - 6 * d + 3 ELSE 0 END"
LANCZOS = "CASE WHEN d = 0 THEN 1 WHEN d < 4 THEN (sin(pi() * d) / (pi() * d)) * (sin(pi() * d / 4) / (pi() * d / 4)) ELSE 0 END"


def resample_sql(scale: int, formula: str, lo: int, hi: int) -> str:
    n = 8 * scale
    return f"""WITH {FR}, {px('fr')}, ps AS (SELECT o, (o + 0.5e0) / {scale} - 0.5e0 AS pos FROM (SELECT unnest(range({n})) AS o)),
    tp AS (SELECT o, floor(pos) + k AS src, abs(pos - (floor(pos) + k)) AS d FROM ps, (SELECT unnest(range({lo}, {hi})) AS k)),
    kw AS (SELECT o, CAST(greatest(0, least(7, src)) AS INT) AS s, {formula} AS k FROM tp),
    wt AS (SELECT o, s, sum(k) / max(n) AS k FROM (SELECT *, sum(k) OVER (PARTITION BY o) AS n FROM kw) GROUP BY o, s),
    rw AS (SELECT {K1}, px.y, wt.o AS x, sum(k * luma) AS v FROM px JOIN wt ON wt.s = px.x GROUP BY {K1}, px.y, wt.o)
    SELECT {K1}, CAST(wt.o AS INT) AS y, CAST(rw.x AS INT) AS x, {S6('greatest(0, least(255, sum(k * v)))')} AS v FROM rw JOIN wt ON wt.s = rw.y GROUP BY {K1}, wt.o, rw.x"""


@query("frm36_resample_cubic_x4", resample_sql(4, CUBIC, -1, 3))
def frm36_cubic(t):
    return rounded(to_pixels(O.resample(frames(t), 4, "cubic")), "v")


@query("frm36_resample_lanczos4_x2", resample_sql(2, LANCZOS, -3, 5))
def frm36_lanczos(t):
    return rounded(to_pixels(O.resample(frames(t), 2, "lanczos4")), "v")


@query(
    "frm37_blend_masked",
    f"""WITH RECURSIVE {SAFE}, {safe_sql('weak', 's0')}, {ENH} SELECT {K1}, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x,
    CASE WHEN B[i + 1] THEN E[i + 1] ELSE L[i + 1] END AS v FROM s0 JOIN en USING ({K1}), {GRID}""",
)
def frm37(t):
    return to_pixels(O.blend_masked(safe(t, "weak"), enhanced(frames(t))))


# Tiles --------------------------------------------------------------------------------------------

TILE_TABLE = """til AS (SELECT i AS tile_id, i % 2 AS c, i // 2 AS r FROM (SELECT unnest(range(4)) AS i)),
tg AS (SELECT CAST(tile_id AS INT) AS tile_id, CAST(greatest(0, c * 3 - c) AS INT) AS tx, CAST(greatest(0, r * 3 - r) AS INT) AS ty, CAST(6 AS INT) AS tw, CAST(6 AS INT) AS th,
  CAST(c AS INT) AS "left", CAST(1 - c AS INT) AS "right", CAST(r AS INT) AS top, CAST(1 - r AS INT) AS bottom FROM til)"""


@query("til1_make_tiles", f"WITH {FR}, {TILE_TABLE} SELECT {K1}, tile_id, tx, ty, tw, th, \"left\", \"right\", top, bottom FROM fr, tg")
def til1(t):
    return O.make_tiles(frames(t).drop("luma"), 5, 2).drop("w", "h")


@query(
    "til1_make_tiles_assets",
    """WITH a AS (SELECT p_partkey AS asset_id, p_size * 80 AS w, p_size * 45 AS h FROM part), n AS (SELECT *, CASE WHEN w <= 512 THEN 1 ELSE 1 + CAST(ceil((w - 512) / 448) AS INT) END AS nx,
      CASE WHEN h <= 512 THEN 1 ELSE 1 + CAST(ceil((h - 512) / 448) AS INT) END AS ny FROM a),
    t AS (SELECT *, unnest(range(nx * ny)) AS tile_id FROM n), c AS (SELECT *, tile_id % nx AS c, tile_id // nx AS r FROM t),
    b AS (SELECT *, CASE WHEN c > 0 THEN 32 ELSE 0 END AS lf, CASE WHEN c < nx - 1 THEN 32 ELSE 0 END AS rt, CASE WHEN r > 0 THEN 32 ELSE 0 END AS tp, CASE WHEN r < ny - 1 THEN 32 ELSE 0 END AS bt FROM c)
    SELECT asset_id, CAST(tile_id AS INT) AS tile_id, CAST(greatest(0, c * 448 - lf) AS INT) AS tx, CAST(greatest(0, r * 448 - tp) AS INT) AS ty,
      CAST(least(least(512, w - c * 448) + lf + rt, w - greatest(0, c * 448 - lf)) AS INT) AS tw, CAST(least(least(512, h - r * 448) + tp + bt, h - greatest(0, r * 448 - tp)) AS INT) AS th FROM b""",
)
def til1_assets(t):
    sizes = t.part.selectExpr("p_partkey AS asset_id", "p_size * 80 AS w", "p_size * 45 AS h")
    return O.make_tiles(sizes, 512, 64).select("asset_id", "tile_id", "tx", "ty", "tw", "th")


@query(
    "til1_make_tiles_pinned",
    f"""WITH {FR}, s AS (SELECT unnest([0, 3]) AS p), t AS (SELECT CAST((CASE y.p WHEN 0 THEN 0 ELSE 2 END) + (CASE x.p WHEN 0 THEN 0 ELSE 1 END) AS INT) AS tile_id, CAST(x.p AS INT) AS tx, CAST(y.p AS INT) AS ty FROM s x, s y)
    SELECT {K1}, tile_id, tx, ty, CAST(5 AS INT) AS tw, CAST(5 AS INT) AS th, CASE WHEN tx > 0 THEN 2 ELSE 0 END AS "left", CASE WHEN tx + 5 < 8 THEN 2 ELSE 0 END AS "right",
      CASE WHEN ty > 0 THEN 2 ELSE 0 END AS top, CASE WHEN ty + 5 < 8 THEN 2 ELSE 0 END AS bottom FROM fr, t""",
)
def til1_pinned(t):
    return O.make_tiles_pinned(frames(t).drop("luma"), 5, 2).drop("w", "h")


WEIGHTS = """tp AS (SELECT tg.*, iy, ix, ty + iy AS y, tx + ix AS x FROM tg, (SELECT unnest(range(6)) AS iy) a, (SELECT unnest(range(6)) AS ix) b),
tw AS (SELECT *, (CASE WHEN "left" > 0 AND ix < "left" THEN ix / "left" ELSE 1 END) * (CASE WHEN "right" > 0 AND 5 - ix < "right" THEN (5 - ix) / "right" ELSE 1 END)
  * (CASE WHEN top > 0 AND iy < top THEN iy / top ELSE 1 END) * (CASE WHEN bottom > 0 AND 5 - iy < bottom THEN (5 - iy) / bottom ELSE 1 END) AS weight,
  (CASE WHEN ix < 1 THEN exp(-9e0) ELSE 1 END) * (CASE WHEN 5 - ix < 1 THEN exp(-9e0) ELSE 1 END) * (CASE WHEN iy < 1 THEN exp(-9e0) ELSE 1 END) * (CASE WHEN 5 - iy < 1 THEN exp(-9e0) ELSE 1 END) AS bell FROM tp)"""


@query(
    "til2_tile_weights",
    f"WITH {FR}, {TILE_TABLE}, {WEIGHTS} SELECT {K1}, tile_id, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {S6('weight')} AS weight, {S6('bell')} AS bell FROM fr, tw",
)
def til2(t):
    px = O.tile_pixels(O.make_tiles(frames(t).drop("luma"), 5, 2))
    return px.select("asset_id", "frame_no", "tile_id", "y", "x", r6(O.tile_weight()).alias("weight"), r6(O.tile_weight_gaussian(3)).alias("bell"))


@query(
    "til3_assemble_tiles",
    f"""WITH {FR}, {TILE_TABLE}, {WEIGHTS}, v AS (SELECT {K1}, y, x, weight, L[y * 8 + x + 1] + tile_id * 10 AS v FROM fr, tw)
    SELECT {K1}, CAST(y AS INT) AS y, CAST(x AS INT) AS x, {S6('CASE WHEN sum(weight) > 0 THEN sum(weight * v) / sum(weight) ELSE avg(v) END')} AS v FROM v GROUP BY {K1}, y, x""",
)
def til3(t):
    px = O.tile_pixels(O.make_tiles(frames(t), 5, 2))
    px = px.select(
        "asset_id", "frame_no", "y", "x", O.tile_weight().alias("weight"),
        (F.get("luma", F.col("y") * F.col("w") + F.col("x")) + F.col("tile_id") * 10).alias("v"),
    )
    return rounded(O.assemble_tiles(px), "v")


@query(
    "til4_tile_batches",
    f"""WITH {FR}, {TILE_TABLE} SELECT {K1}, CAST(tile_id // 3 AS INT) AS batch, count(*) AS n_tiles, count(*) FILTER (WHERE (frame_no + tile_id) % 4 <> 0) AS n_ok,
    count(*) FILTER (WHERE (frame_no + tile_id) % 4 = 0) AS n_failed FROM fr, tg GROUP BY {K1}, tile_id // 3""",
)
def til4(t):
    tiles = O.make_tiles(frames(t).drop("luma"), 5, 2).withColumn("success", F.expr("(frame_no + tile_id) % 4 <> 0"))
    return O.tile_batches(tiles, 3)
