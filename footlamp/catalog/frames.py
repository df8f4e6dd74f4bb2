"""Queries: frame sampling, measures, classes, scores and the enhancement plan (FRM1-20, PLN5, AGG1-2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from footlamp.catalog.fixtures import FRAMES_CTE, LUMA, channels, frames
from footlamp.catalog.registry import query
from footlamp.catalog.registry import r6 as S6
from footlamp.functions.scalars import r6
from footlamp.operators import frames as O

N = 20
FR = (
    FRAMES_CTE
    + f""", fr AS (SELECT asset_id, frame_no, list_transform(embedding, lambda v: CAST({LUMA} AS INT)) AS L FROM frame_src),
tot AS (SELECT asset_id, count(*) AS total FROM fr GROUP BY asset_id)"""
)
SM = f"""sm AS (SELECT fr.*, total, frame_no // greatest(1, total // {N}) AS sample_no FROM fr JOIN tot USING (asset_id)
WHERE frame_no % greatest(1, total // {N}) = 0 AND (total <= {N} OR frame_no // greatest(1, total // {N}) < {N})),
smp AS (SELECT *, lag(L) OVER (PARTITION BY asset_id ORDER BY sample_no) AS P FROM sm)"""

WHOLE = "smp AS (SELECT fr.*, frame_no AS sample_no, lag(L) OVER (PARTITION BY asset_id ORDER BY frame_no) AS P FROM fr)"


def px(src: str, name: str = "px") -> str:
    return f"{name} AS (SELECT s.*, CAST(i // 8 AS INT) AS y, CAST(i % 8 AS INT) AS x, L[i + 1] AS luma, i FROM {src} s, (SELECT unnest(range(64)) AS i) g)"


def nb(dy: int, dx: int, arr: str = "L") -> str:
    """Mirrored neighbour in an 8x8 packed list."""
    return f"{arr}[(7 - abs(7 - abs(y + {dy}))) * 8 + (7 - abs(7 - abs(x + {dx}))) + 1]"


def rep(dy: int, dx: int, arr: str = "L") -> str:
    """Neighbour with repeated border."""
    return f"{arr}[greatest(0, least(7, y + {dy})) * 8 + greatest(0, least(7, x + {dx})) + 1]"


def sobel(n=nb, arr="L") -> tuple[str, str]:
    gx = f"({n(-1, 1, arr)} + 2 * {n(0, 1, arr)} + {n(1, 1, arr)} - {n(-1, -1, arr)} - 2 * {n(0, -1, arr)} - {n(1, -1, arr)})"
    gy = f"({n(1, -1, arr)} + 2 * {n(1, 0, arr)} + {n(1, 1, arr)} - {n(-1, -1, arr)} - 2 * {n(-1, 0, arr)} - {n(-1, 1, arr)})"
    return gx, gy


LAP = f"({nb(-1, 0)} + {nb(1, 0)} + {nb(0, -1)} + {nb(0, 1)} - 4 * luma)"
GX, GY = sobel()
MAG = f"sqrt(({GX} * {GX} + {GY} * {GY})::DOUBLE)"


def canny(src: str, out: str, arr: str = "L") -> str:
    """Edge pixels of every frame of ``src``: ``{out}_e``(asset_id, frame_no, y, x); needs WITH RECURSIVE."""
    gx, gy = sobel(rep, arr)

    def m(dy, dx):
        return f"coalesce(CASE WHEN y + {dy} BETWEEN 0 AND 7 AND x + {dx} BETWEEN 0 AND 7 THEN M[(y + {dy}) * 8 + x + {dx} + 1] END, 0)"

    low, high = 0.41421356237309503, 2.414213562373095
    return f"""{px(src, out + '_p')},
{out}_g AS (SELECT asset_id, frame_no, y, x, i, {gx} AS gx, {gy} AS gy FROM {out}_p),
{out}_m AS (SELECT *, abs(gx) + abs(gy) AS mag FROM {out}_g),
{out}_l AS (SELECT asset_id, frame_no, list(mag ORDER BY i) AS M FROM {out}_m GROUP BY asset_id, frame_no),
{out}_c AS (SELECT asset_id, frame_no, y, x, mag FROM {out}_m JOIN {out}_l USING (asset_id, frame_no) WHERE mag > 50 AND
  CASE WHEN abs(gy) < {low}e0 * abs(gx) THEN mag > {m(0, -1)} AND mag >= {m(0, 1)}
    WHEN abs(gy) > {high}e0 * abs(gx) THEN mag > {m(-1, 0)} AND mag >= {m(1, 0)}
    WHEN (gx < 0) = (gy < 0) THEN mag > {m(-1, -1)} AND mag > {m(1, 1)} ELSE mag > {m(-1, 1)} AND mag > {m(1, -1)} END),
{out}_e AS (SELECT asset_id, frame_no, y, x FROM {out}_c WHERE mag > 150
  UNION SELECT c.asset_id, c.frame_no, c.y, c.x FROM {out}_e e JOIN {out}_c c ON c.asset_id = e.asset_id AND c.frame_no = e.frame_no
    AND abs(c.y - e.y) <= 1 AND abs(c.x - e.x) <= 1),
{out}_d AS (SELECT s.asset_id, s.frame_no, coalesce(n, 0) / 64e0 AS edges FROM {src} s
  LEFT JOIN (SELECT asset_id, frame_no, count(*) AS n FROM {out}_e GROUP BY asset_id, frame_no) k USING (asset_id, frame_no))"""


def totals(t):
    return t.embeddings.groupBy(F.col("label").alias("asset_id")).agg(F.count(F.lit(1)).alias("total"))


def sampled(t):
    return O.sample_frames(frames(t), N, totals(t))


def rounded(df, *cols):
    return df.select(*[r6(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("frm1_sample_frames", f"WITH {FR}, {SM} SELECT asset_id, frame_no, sample_no FROM sm")
def frm1(t):
    return sampled(t).select("asset_id", "frame_no", "sample_no")


@query(
    "frm1_sample_linspace",
    f"""WITH {FR}, g AS (SELECT asset_id, CAST(trunc(i * ((total - 1) / 9e0)) AS BIGINT) AS frame_no FROM tot, (SELECT unnest(range(10)) AS i) r)
    SELECT DISTINCT asset_id, frame_no FROM g""",
)
def frm1_linspace(t):
    return O.sample_linspace(frames(t), 10, totals(t)).select("asset_id", "frame_no")


@query("frm1_sample_every", f"WITH {FR} SELECT asset_id, frame_no FROM fr WHERE frame_no % 3 = 0 AND frame_no // 3 < 15")
def frm1_every(t):
    return O.sample_every(frames(t), 3, 15).select("asset_id", "frame_no")


@query(
    "frm1_sample_stride",
    f"WITH {FR} SELECT asset_id, frame_no FROM fr JOIN tot USING (asset_id) WHERE frame_no % greatest(1, total // 50) = 0 AND frame_no // greatest(1, total // 50) < 50",
)
def frm1_stride(t):
    return O.sample_stride(frames(t), 50, totals(t)).select("asset_id", "frame_no")


LIGHT = "l AS (SELECT asset_id, frame_no, avg(CASE WHEN luma / 255e0 > 0.85e0 THEN 1 ELSE 0 END) AS hi, avg(CASE WHEN luma / 255e0 < 0.15e0 THEN 1 ELSE 0 END) AS lo FROM px GROUP BY asset_id, frame_no)"


@query(
    "frm2_lighting_ratios",
    f"WITH {FR}, {WHOLE}, {px('smp')}, {LIGHT} SELECT asset_id, {S6('avg(hi)')} AS highlight, {S6('avg(lo)')} AS dark, {S6('avg(1 - hi - lo)')} AS midtone FROM l GROUP BY asset_id",
)
def frm2(t):
    return rounded(O.lighting_ratios(frames(t)), "highlight", "dark", "midtone")


@query(
    "frm3_edge_density",
    f"WITH RECURSIVE {FR}, {WHOLE}, {canny('smp', 'k')} SELECT asset_id, {S6('avg(edges)')} AS edge_density FROM k_d GROUP BY asset_id",
)
def frm3(t):
    return rounded(O.edge_density(frames(t)), "edge_density")


CHANGE = "ch AS (SELECT asset_id, sample_no, avg(abs(luma - P[i + 1]) / 255e0) AS d FROM px GROUP BY asset_id, sample_no)"


@query(
    "frm4_frame_change",
    f"WITH {FR}, {WHOLE}, {px('smp')}, {CHANGE} SELECT asset_id, {S6('coalesce(avg(d), 0)')} AS frame_change, coalesce(avg(d), 0) < 0.02e0 AS is_static FROM ch GROUP BY asset_id",
)
def frm4(t):
    return rounded(O.frame_change(frames(t), "frame_no"), "frame_change")


NOISE = f"ns AS (SELECT asset_id, frame_no, least(1e0, var_pop({LAP}) / 1000) AS n FROM px GROUP BY asset_id, frame_no)"


@query("frm5_noise_score", f"WITH {FR}, {WHOLE}, {px('smp')}, {NOISE} SELECT asset_id, {S6('avg(n)')} AS noise_score FROM ns GROUP BY asset_id")
def frm5(t):
    return rounded(O.noise_score(frames(t)), "noise_score")


FEATURES = f"""{FR}, {WHOLE}, {px('smp')}, {LIGHT}, {CHANGE}, {NOISE}, {canny('smp', 'k')},
ft AS (SELECT tot.asset_id, 8 AS width, 8 AS height, 25e0 AS fps, total AS total_frames, total / 25e0 AS duration_s,
  (SELECT avg(hi) FROM l WHERE l.asset_id = tot.asset_id) AS highlight, (SELECT avg(lo) FROM l WHERE l.asset_id = tot.asset_id) AS dark,
  (SELECT avg(1 - hi - lo) FROM l WHERE l.asset_id = tot.asset_id) AS midtone,
  (SELECT avg(edges) FROM k_d WHERE k_d.asset_id = tot.asset_id) AS edge_density,
  (SELECT coalesce(avg(d), 0) FROM ch WHERE ch.asset_id = tot.asset_id) AS frame_change,
  (SELECT avg(n) FROM ns WHERE ns.asset_id = tot.asset_id) AS noise_score FROM tot)"""
FEATURE_NUMS = ["highlight", "dark", "midtone", "edge_density", "frame_change", "noise_score"]


def features(t):
    return O.structure_features(frames(t), total=totals(t))


@query(
    "frm6_structure_features",
    f"""WITH RECURSIVE {FEATURES} SELECT asset_id, width, height, total_frames, {', '.join(f'{S6(c)} AS {c}' for c in FEATURE_NUMS)}, fps, duration_s,
    frame_change < 0.02e0 AS is_static FROM ft""",
)
def frm6(t):
    return rounded(features(t), *FEATURE_NUMS)


@query(
    "pln5_plan_enhancement",
    f"""WITH RECURSIVE {FEATURES} SELECT asset_id, 'x2,x2' AS resolution_plan, highlight <= 0.2e0 AS gan_allowed,
    CASE WHEN highlight > 0.2e0 THEN 'medium' WHEN noise_score > 0.25e0 THEN 'weak' WHEN edge_density > 0.3e0 THEN 'strong' ELSE 'medium' END AS gan_strength,
    frame_change < 0.02e0 AS background_lock, CASE WHEN frame_change < 0.02e0 THEN 'high' ELSE 'medium' END AS temporal_strength, 512 AS tile_size,
    CASE WHEN edge_density > 0.2e0 THEN 'small' WHEN highlight > 0.15e0 THEN 'large' ELSE 'medium' END AS venue,
    substring(md5(printf('8x8_25.00fps_static:%s_highlight:%.3f_edge:%.3f_motion:%.3f_noise:%.3f', CASE WHEN frame_change < 0.02e0 THEN 'True' ELSE 'False' END,
      highlight, edge_density, frame_change, noise_score)), 1, 16) AS features_hash FROM ft""",
)
def pln5(t):
    return O.plan_enhancement(features(t))


BLOCK = """bk AS (SELECT asset_id, frame_no, sum((CASE WHEN x // 2 < 3 AND y // 2 < 3 AND x % 2 = 1 THEN abs(luma - L[y * 8 + x + 2]) ELSE 0 END)
  + (CASE WHEN x // 2 < 3 AND y // 2 < 3 AND y % 2 = 1 THEN abs(luma - L[(y + 1) * 8 + x + 1]) ELSE 0 END)) / 2e0 / 255 / 9 AS b,
  sum((CASE WHEN x // 2 < 3 AND y // 2 < 3 AND x % 2 = 1 THEN (luma - L[y * 8 + x + 2] + 256) % 256 ELSE 0 END)
  + (CASE WHEN x // 2 < 3 AND y // 2 < 3 AND y % 2 = 1 THEN (luma - L[(y + 1) * 8 + x + 1] + 256) % 256 ELSE 0 END)) / 2e0 / 255 / 9 AS bw FROM px GROUP BY asset_id, frame_no)"""


@query(
    "frm7_quality_levels",
    f"""WITH {FR}, {px('fr')}, {BLOCK},
    m AS (SELECT asset_id, frame_no, var_pop({LAP}) AS nz, avg({MAG}) AS sh, avg(luma) AS br, stddev_pop(luma) AS co FROM px GROUP BY asset_id, frame_no),
    a AS (SELECT asset_id, count(*) AS n_frames, avg(nz) AS noise, avg(sh) AS sharpness, avg(b) AS artifacts, avg(br) AS brightness, avg(co) AS contrast FROM m JOIN bk USING (asset_id, frame_no) GROUP BY asset_id),
    v AS (SELECT *, CASE WHEN noise > 500 THEN 'low' WHEN noise > 200 THEN 'moderate' ELSE 'high' END AS noise_level,
      CASE WHEN sharpness > 30 THEN 'high' WHEN sharpness > 15 THEN 'moderate' ELSE 'low' END AS sharpness_level,
      CASE WHEN artifacts < 0.1e0 THEN 'low' WHEN artifacts < 0.2e0 THEN 'moderate' ELSE 'high' END AS artifact_level FROM a),
    w AS (SELECT *, list_filter([CASE WHEN noise_level = 'high' THEN 'noise' END, CASE WHEN sharpness_level = 'low' THEN 'sharpness' END,
      CASE WHEN artifact_level = 'high' THEN 'artifacts' END], lambda c: c IS NOT NULL) AS iss FROM v)
    SELECT asset_id, n_frames, {', '.join(f'{S6(c)} AS {c}' for c in ('noise', 'sharpness', 'artifacts', 'brightness', 'contrast'))}, noise_level, sharpness_level, artifact_level,
      concat(CASE len(iss) WHEN 0 THEN 'good' WHEN 1 THEN 'moderate' ELSE 'poor' END, ':', array_to_string(iss, ',')) AS summary FROM w""",
)
def frm7(t):
    return rounded(O.quality_levels(frames(t), block=2), "noise", "sharpness", "artifacts", "brightness", "contrast")


@query(
    "frm8_blockiness",
    f"WITH {FR}, {px('fr')}, {BLOCK} SELECT asset_id, frame_no, {S6('b')} AS blockiness, {S6('bw')} AS blockiness_wrapped FROM bk",
)
def frm8(t):
    return rounded(O.blockiness(frames(t), 2), "blockiness", "blockiness_wrapped")


COLOUR = "cp AS (SELECT asset_id, frame_no, luma AS b, (luma + 64) % 256 AS g, (luma * 3) % 256 AS r, greatest(luma, (luma + 64) % 256, (luma * 3) % 256) AS v FROM px)"
LCLS = "CASE WHEN s > 60 AND wm > 1.2e0 {0} THEN 'stage' WHEN m > 120 AND s < 40 {1} THEN 'natural' ELSE 'mixed' END"
LIGHTING = f"""{COLOUR}, lc AS (SELECT asset_id, frame_no, avg(v) AS m, stddev_pop(v) AS s, avg(r) / (avg(b) + 1) AS wm FROM cp GROUP BY asset_id, frame_no),
hb AS (SELECT asset_id, frame_no, v, count(*) AS n FROM cp GROUP BY asset_id, frame_no, v),
pk AS (SELECT h.asset_id, h.frame_no, count(*) FILTER (WHERE h.v BETWEEN 1 AND 254 AND h.n > coalesce(a.n, 0) AND h.n > coalesce(z.n, 0)) AS n_peaks FROM hb h
  LEFT JOIN hb a ON a.asset_id = h.asset_id AND a.frame_no = h.frame_no AND a.v = h.v - 1
  LEFT JOIN hb z ON z.asset_id = h.asset_id AND z.frame_no = h.frame_no AND z.v = h.v + 1 GROUP BY h.asset_id, h.frame_no)"""


def coloured(df):
    return df.select("*", *[c.alias(n) for n, c in channels().items()])


@query(
    "frm9_lighting_class",
    f"""WITH {FR}, {px('fr')}, {LIGHTING} SELECT asset_id, frame_no, {S6('m')} AS mean_v, {S6('s')} AS std_v, {S6('wm')} AS warmth, {LCLS.format('', '')} AS lighting, n_peaks,
    {LCLS.format('AND n_peaks <= 3', 'AND n_peaks <= 2')} AS lighting_peaks FROM lc JOIN pk USING (asset_id, frame_no)""",
)
def frm9(t):
    return rounded(O.lighting_class(coloured(frames(t)), peaks=True), "mean_v", "std_v", "warmth")


def measured(df):
    return O.frame_measures(df.withColumn("edges", O.edge_share("luma", "w", "h")))


CCLS = "CASE WHEN edges > 0.15e0 OR lv > 1000 {0} THEN 'complex' WHEN edges > 0.08e0 OR lv > 500 {1} THEN 'moderate' ELSE 'simple' END"
COMPLEX = f"""{canny('fr', 'k')}, lp AS (SELECT asset_id, frame_no, var_pop({LAP}) AS lv FROM px GROUP BY asset_id, frame_no),
cs AS (SELECT asset_id, frame_no, (stddev_pop(b) + stddev_pop(g) + stddev_pop(r)) / 3 AS cstd FROM cp GROUP BY asset_id, frame_no)"""


@query(
    "frm10_complexity_class",
    f"""WITH RECURSIVE {FR}, {px('fr')}, {COLOUR}, {COMPLEX} SELECT asset_id, frame_no, {S6('edges')} AS edges, {S6('lv')} AS laplacian_var, {S6('cstd')} AS colour_std,
    {CCLS.format('', '')} AS complexity, {CCLS.format('OR cstd > 40', 'OR cstd > 25')} AS complexity_colour FROM lp JOIN k_d USING (asset_id, frame_no) JOIN cs USING (asset_id, frame_no)""",
)
def frm10(t):
    f = frames(t)
    df = O.complexity_class(measured(f).join(O.colour_std(coloured(f)), O.KEY))
    cols = ["asset_id", "frame_no", "edges", "laplacian_var", "colour_std", "complexity", "complexity_colour"]
    return rounded(df.select(*cols), "edges", "laplacian_var", "colour_std")


DEPTH = f"""dm AS (SELECT asset_id, frame_no, (avg(mg) FILTER (WHERE y < 2) + avg(mg) FILTER (WHERE y BETWEEN 2 AND 4)) / (avg(mg) FILTER (WHERE y >= 5) + 1) AS dr
  FROM (SELECT asset_id, frame_no, y, {MAG} AS mg FROM px) GROUP BY asset_id, frame_no)"""
DCLS = "CASE WHEN dr > 1.5e0 THEN 'deep' WHEN dr > 0.8e0 THEN 'medium' ELSE 'shallow' END"


@query(
    "frm11_depth_class",
    f"WITH {FR}, {px('fr')}, {DEPTH} SELECT asset_id, frame_no, {S6('dr')} AS depth_ratio, {DCLS} AS depth, {S6('least(dr / 2, 1)')} AS depth_score FROM dm",
)
def frm11(t):
    df = O.depth_class(O.frame_measures(frames(t))).select("asset_id", "frame_no", "depth_ratio", "depth", "depth_score")
    return rounded(df, "depth_ratio", "depth_score")


@query(
    "frm12_composition_class",
    f"""WITH {FR}, {px('fr')}, b AS (SELECT *, CAST(y < 2 AS INT) + CAST(y >= 5 AS INT) + CAST(x < 2 AS INT) + CAST(x >= 5 AS INT) AS k FROM px),
    c AS (SELECT asset_id, frame_no, avg(luma) FILTER (WHERE k = 0) / (sum(luma * k) / sum(k) + 1) AS r FROM b GROUP BY asset_id, frame_no)
    SELECT asset_id, frame_no, {S6('r')} AS composition_ratio, CASE WHEN r > 1.3e0 THEN 'proscenium' WHEN r > 0.8e0 THEN 'thrust' ELSE 'arena' END AS composition FROM c""",
)
def frm12(t):
    return rounded(O.composition_class(frames(t)), "composition_ratio")


@query(
    "frm13_scene_vote",
    f"""WITH RECURSIVE {FR}, {px('fr')}, {LIGHTING}, {COMPLEX}, {DEPTH}, c AS (SELECT asset_id, {LCLS.format('', '')} AS lighting, {CCLS.format('', '')} AS complexity, {DCLS} AS depth
      FROM lc JOIN k_d USING (asset_id, frame_no) JOIN lp USING (asset_id, frame_no) JOIN dm USING (asset_id, frame_no)),
    n AS (SELECT asset_id, count(*) AS n_frames FROM c GROUP BY asset_id),
    li AS (SELECT asset_id, lighting FROM c GROUP BY asset_id, lighting QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, list_position(['stage','natural','mixed'], lighting)) = 1),
    co AS (SELECT asset_id, complexity FROM c GROUP BY asset_id, complexity QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, list_position(['simple','moderate','complex'], complexity)) = 1),
    de AS (SELECT asset_id, depth FROM c GROUP BY asset_id, depth QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY count(*) DESC, list_position(['shallow','medium','deep'], depth)) = 1),
    sh AS (SELECT asset_id, avg(CAST(complexity = 'complex' AS INT)) AS cx, avg(CAST(complexity = 'moderate' AS INT)) AS md FROM c GROUP BY asset_id)
    SELECT asset_id, n_frames, lighting, complexity, depth, CASE WHEN cx > 0.6e0 THEN 5 WHEN cx > 0.3e0 OR md > 0.7e0 THEN 3 ELSE 2 END AS actors,
      CASE WHEN lighting = 'natural' THEN 'real-cugan' ELSE 'realesrgan-x4plus' END AS model,
      CASE WHEN complexity = 'complex' OR depth = 'deep' THEN 'quality' WHEN complexity = 'simple' THEN 'speed' ELSE 'balanced' END AS priority
    FROM n JOIN li USING (asset_id) JOIN co USING (asset_id) JOIN de USING (asset_id) JOIN sh USING (asset_id)""",
)
def frm13(t):
    s = frames(t)
    classes = O.depth_class(O.complexity_class(measured(s))).join(O.lighting_class(coloured(s)), O.KEY)
    return O.scene_vote(classes)


@query(
    "frm14_brightness_stability",
    f"""WITH {FR}, {px('fr')}, m AS (SELECT asset_id, frame_no, avg(luma) / 255 AS m FROM px GROUP BY asset_id, frame_no)
    SELECT asset_id, {S6('CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0e0, 1 - 5 * stddev_pop(m)) END')} AS score FROM m GROUP BY asset_id""",
)
def frm14(t):
    return rounded(O.brightness_stability(frames(t)), "score")


@query(
    "frm15_edge_stability",
    f"""WITH RECURSIVE {FR}, {canny('fr', 'k')}
    SELECT asset_id, {S6('CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0e0, 1 - 10 * stddev_pop(edges)) END')} AS score FROM k_d GROUP BY asset_id""",
)
def frm15(t):
    return rounded(O.edge_stability(frames(t)), "score")


@query(
    "frm16_highlight_clipping",
    f"""WITH {FR}, {px('fr')}, {COLOUR},
    m AS (SELECT asset_id, frame_no, sum(CAST(b >= 250 AS INT) + CAST(g >= 250 AS INT) + CAST(r >= 250 AS INT)) / 192e0 AS c FROM cp GROUP BY asset_id, frame_no)
    SELECT asset_id, {S6('greatest(0e0, 1 - 20 * avg(c))')} AS score FROM m GROUP BY asset_id""",
)
def frm16(t):
    return rounded(O.highlight_clipping(coloured(frames(t))), "score")


@query(
    "frm17_flicker",
    f"""WITH {FR}, g AS (SELECT *, lag(L) OVER (PARTITION BY asset_id ORDER BY frame_no) AS P FROM fr), {px('g')},
    d AS (SELECT asset_id, frame_no, avg(abs(luma - P[i + 1])) AS d FROM px GROUP BY asset_id, frame_no)
    SELECT asset_id, count(d) AS n_pairs, coalesce(stddev_pop(d) > avg(d) * 0.5e0, false) AS flickering,
      {S6('CASE WHEN count(d) > 0 THEN greatest(0e0, 1 - stddev_pop(d) / 255) ELSE 0 END')} AS temporal_consistency FROM d GROUP BY asset_id""",
)
def frm17(t):
    return rounded(O.flicker(frames(t)), "temporal_consistency")


ENH = "en AS (SELECT *, list_transform(L, lambda v: CAST(least(255, floor(v * 1.1e0)) AS INT)) AS E FROM fr)"


def enhanced(df):
    return df.withColumn("luma", F.expr("transform(luma, v -> CAST(least(255, floor(v * 1.1e0)) AS INT))"))


def pairs(t):
    f = frames(t)
    return O.pair_frames(f, enhanced(f))


@query(
    "frm18_psnr",
    f"""WITH {FR}, {ENH}, {px('en')}, m AS (SELECT asset_id, frame_no, avg((luma - E[i + 1]) * (luma - E[i + 1])) AS mse FROM px GROUP BY asset_id, frame_no),
    p AS (SELECT asset_id, CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) END AS p FROM m)
    SELECT asset_id, {S6('avg(p)')} AS psnr_mean, {S6('stddev_pop(p)')} AS psnr_std, {S6('avg(least(100, coalesce(p, 100)))')} AS psnr_capped FROM p GROUP BY asset_id""",
)
def frm18(t):
    return rounded(O.psnr(pairs(t)), "psnr_mean", "psnr_std", "psnr_capped")


@query(
    "frm19_ssim",
    f"""WITH {FR}, {ENH}, {px('en')}, w AS (SELECT p.asset_id, p.frame_no, o.wy, o.wx, p.luma::DOUBLE AS a, p.E[p.i + 1]::DOUBLE AS b FROM px p
      JOIN (SELECT a.k AS wy, b.k AS wx FROM (SELECT unnest(range(2)) AS k) a, (SELECT unnest(range(2)) AS k) b) o ON p.y BETWEEN o.wy AND o.wy + 6 AND p.x BETWEEN o.wx AND o.wx + 6),
    s AS (SELECT asset_id, frame_no, wy, wx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM w GROUP BY ALL),
    f AS (SELECT asset_id, frame_no, avg((2 * ma * mb + 6.5025e0) * (2 * c + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (va + vb + 58.5225e0))) AS s FROM s GROUP BY asset_id, frame_no)
    SELECT asset_id, {S6('avg(s)')} AS ssim_mean, {S6('stddev_pop(s)')} AS ssim_std FROM f GROUP BY asset_id""",
)
def frm19(t):
    return rounded(O.ssim(pairs(t)), "ssim_mean", "ssim_std")


@query(
    "frm20_improvement",
    f"""WITH RECURSIVE {FR}, {ENH}, ee AS (SELECT asset_id, frame_no, E AS L FROM en), {px('en')}, {canny('fr', 'k')}, {canny('ee', 'j')},
    m AS (SELECT asset_id, frame_no, stddev_pop(luma) AS s0, stddev_pop(E[i + 1]) AS s1 FROM px GROUP BY asset_id, frame_no),
    d AS (SELECT m.asset_id, CASE WHEN k_d.edges > 0 THEN (j_d.edges - k_d.edges) / k_d.edges ELSE 0 END AS d, CASE WHEN s0 > 0 THEN (s1 - s0) / s0 ELSE 0 END AS c
      FROM m JOIN k_d USING (asset_id, frame_no) JOIN j_d USING (asset_id, frame_no))
    SELECT asset_id, {S6('avg(d)')} AS detail, {S6('avg(c)')} AS clarity, {S6('(avg(d) + avg(c) + 1) / 3')} AS overall FROM d GROUP BY asset_id""",
)
def frm20(t):
    return rounded(O.improvement(pairs(t)), "detail", "clarity", "overall")


@query(
    "frm21_quality_advice",
    f"""WITH RECURSIVE {FR}, {ENH}, ee AS (SELECT asset_id, frame_no, E AS L, lag(E) OVER (PARTITION BY asset_id ORDER BY frame_no) AS P FROM en), {px('en')}, {px('ee', 'pe')}, {canny('fr', 'k')}, {canny('ee', 'j')},
    q AS (SELECT asset_id, frame_no, avg((luma - E[i + 1]) * (luma - E[i + 1])) AS mse, stddev_pop(luma) AS s0, stddev_pop(E[i + 1]) AS s1 FROM px GROUP BY asset_id, frame_no),
    p AS (SELECT asset_id, avg(CASE WHEN mse > 0 THEN 10 * log10(65025 / mse) END) AS psnr FROM q GROUP BY asset_id),
    w AS (SELECT p.asset_id, p.frame_no, o.wy, o.wx, p.luma::DOUBLE AS a, p.E[p.i + 1]::DOUBLE AS b FROM px p
      JOIN (SELECT a.k AS wy, b.k AS wx FROM (SELECT unnest(range(2)) AS k) a, (SELECT unnest(range(2)) AS k) b) o ON p.y BETWEEN o.wy AND o.wy + 6 AND p.x BETWEEN o.wx AND o.wx + 6),
    s AS (SELECT asset_id, frame_no, wy, wx, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM w GROUP BY ALL),
    f AS (SELECT asset_id, avg(s) AS ssim FROM (SELECT asset_id, frame_no, avg((2 * ma * mb + 6.5025e0) * (2 * c + 58.5225e0) / ((ma * ma + mb * mb + 6.5025e0) * (va + vb + 58.5225e0))) AS s
      FROM s GROUP BY asset_id, frame_no) GROUP BY asset_id),
    d AS (SELECT q.asset_id, (avg(CASE WHEN k_d.edges > 0 THEN (j_d.edges - k_d.edges) / k_d.edges ELSE 0 END) + avg(CASE WHEN s0 > 0 THEN (s1 - s0) / s0 ELSE 0 END) + 1) / 3 AS overall
      FROM q JOIN k_d USING (asset_id, frame_no) JOIN j_d USING (asset_id, frame_no) GROUP BY q.asset_id),
    c AS (SELECT asset_id, coalesce(stddev_pop(d) > avg(d) * 0.5e0, false) AS flickering FROM (SELECT asset_id, frame_no, avg(abs(luma - P[i + 1])) AS d FROM pe GROUP BY asset_id, frame_no) GROUP BY asset_id)
    SELECT asset_id, array_to_string(list_filter([CASE WHEN psnr < 25 THEN 'psnr_low' WHEN psnr > 35 THEN 'psnr_excellent' END, CASE WHEN ssim < 0.8e0 THEN 'ssim_low' WHEN ssim > 0.9e0 THEN 'ssim_excellent' END,
      CASE WHEN asset_id * 1.5e0 < 2 THEN 'size_reasonable' WHEN asset_id * 1.5e0 > 10 THEN 'compress' END, CASE WHEN overall > 0.1e0 THEN 'improved' ELSE 'improvement_limited' END,
      CASE WHEN flickering THEN 'flickering' END], lambda c: c IS NOT NULL), ',') AS advice
    FROM p JOIN f USING (asset_id) JOIN d USING (asset_id) JOIN c USING (asset_id)""",
)
def frm21_advice(t):
    p = pairs(t)
    flicker = O.flicker(enhanced(frames(t))).select("asset_id", "flickering")
    measures = O.psnr(p).join(O.ssim(p), "asset_id").join(O.improvement(p), "asset_id").join(flicker, "asset_id")
    return O.quality_advice(measures.withColumn("size_ratio", F.col("asset_id") * 1.5))


STABLE = f"""{FR}, {px('fr')}, {COLOUR}, {canny('fr', 'k')},
st AS (SELECT asset_id, greatest(0e0, 1 - 5 * stddev_pop(m)) AS brightness_score FROM (SELECT asset_id, frame_no, avg(luma) / 255 AS m FROM px GROUP BY ALL) GROUP BY asset_id),
es AS (SELECT asset_id, greatest(0e0, 1 - 10 * stddev_pop(edges)) AS edge_score FROM k_d GROUP BY asset_id),
hc AS (SELECT asset_id, greatest(0e0, 1 - 20 * avg(c)) AS clipping_score FROM (SELECT asset_id, frame_no, sum(CAST(b >= 250 AS INT) + CAST(g >= 250 AS INT) + CAST(r >= 250 AS INT)) / 192e0 AS c
  FROM cp GROUP BY ALL) GROUP BY asset_id),
sc AS (SELECT * FROM st JOIN es USING (asset_id) JOIN hc USING (asset_id))"""


def stability_scores(t):
    f = frames(t)
    return (
        O.brightness_stability(f).withColumnRenamed("score", "brightness_score")
        .join(O.edge_stability(f).withColumnRenamed("score", "edge_score"), "asset_id")
        .join(O.highlight_clipping(coloured(f)).withColumnRenamed("score", "clipping_score"), "asset_id")
    )


@query(
    "agg2_master_metrics",
    f"""WITH RECURSIVE {STABLE} SELECT asset_id, {S6('8 + asset_id % 2 * 8e0')} AS pixel_ratio, {S6('least(1e0, (8 + asset_id % 2 * 8e0) / (CASE WHEN asset_id % 3 = 0 THEN 2 ELSE 64 END))')} AS compliance,
    {S6('(brightness_score + edge_score + clipping_score) / 3')} AS stability FROM sc""".replace("ELSE 64", "ELSE 4"),
)
def agg2(t):
    s = stability_scores(t).selectExpr(
        "*", "8 AS width", "8 AS height", "8 AS out_h", "8 * (8 + asset_id % 2 * 8) AS out_w", "CASE WHEN asset_id % 3 = 0 THEN 1 ELSE 2 END AS n_steps"
    )
    df = O.master_metrics(s).select("asset_id", "pixel_ratio", "compliance", "stability")
    return rounded(df, "pixel_ratio", "compliance", "stability")


@query(
    "agg1_overall_score",
    f"""WITH RECURSIVE {STABLE}, m AS (SELECT asset_id, 'visual' AS grp, 'brightness' AS name, brightness_score AS value FROM sc UNION ALL SELECT asset_id, 'visual', 'edges', edge_score FROM sc
      UNION ALL SELECT asset_id, 'master', 'clipping', clipping_score FROM sc UNION ALL SELECT asset_id, 'files', 'size_mb', asset_id * 1.5e0 FROM sc
      UNION ALL SELECT asset_id, 'files', 'validation_error', 1e0 FROM sc)
    SELECT asset_id, grp, count(*) AS n_metrics, {S6('avg(value)')} AS score FROM m WHERE name <> 'validation_error' GROUP BY GROUPING SETS ((asset_id, grp), (asset_id))""",
)
def agg1(t):
    wide = stability_scores(t).selectExpr("*", "asset_id * 1.5e0 AS size_mb", "1e0 AS validation_error")
    groups = {"visual": ["brightness_score", "edge_score"], "master": ["clipping_score"], "files": ["size_mb", "validation_error"]}
    return rounded(O.overall_score(O.quality_metrics(wide, groups)), "score")
