"""SQL of the tone and geometry functions, for checking queries in another engine."""

from __future__ import annotations

import math

from ..functions import geodesy
from ..sources import tables


def num(x: float) -> str:
    text = repr(float(x))
    return text if "e" in text else text + "e0"


def tall() -> str:
    """The height of the image of tables.pixels()."""
    return f"(SELECT max(y) + 1 FROM ({tables.PIXELS}))"


def clip(v: str, low: float = 0.0) -> str:
    return f"greatest({num(low)}, least(1e0, {v}))"


def brightness(v: str, b: float) -> str:
    return clip(f"{v} * {num(b)}")


def contrast(v: str, c: float) -> str:
    return clip(f"({v} - 0.5e0) * {num(c)} + 0.5e0")


LUMA = "(0.299e0 * r + 0.587e0 * g + 0.114e0 * b)"


def saturation(v: str, s: float) -> str:
    return clip(f"{LUMA} * {num(1 - s)} + {v} * {num(s)}")


def gamma(v: str, b: float) -> str:
    return clip(f"pow({clip(v, 1e-6)}, {num(min(8.0, max(0.125, 2.0**-b)))})")


def s_curve(v: str, c: float) -> str:
    if c < 0:
        return clip(f"{v} * {num(1 + c)} + {num(-0.5 * c)}")
    k = 5 + 20 * c
    low, high = 1 / (1 + math.exp(0.5 * k)), 1 / (1 + math.exp(-0.5 * k))
    return clip(f"{v} * {num(1 - c)} + (1e0 / (1e0 + exp({num(-k)} * ({v} - 0.5e0))) - {num(low)}) / {num(high - low)} * {num(c)}")


def truncated(v: str) -> str:
    return f"CAST(floor({clip(v)} * 255e0) AS INTEGER)"


GLI = "((2e0 * g - r - b) / (2e0 * g + r + b + 1e-8))"


def to_hsv(source: str, keep: str = "image_id, y, x, r, g, b") -> str:
    """A subquery with h, s, v from r, g, b in [0, 1]."""
    return f"""(SELECT {keep}, CASE WHEN hh < 0 THEN hh + 180 ELSE hh END / 255e0 AS h, floor((d8 * CASE WHEN v8 > 0 THEN round_even(1044480e0 / v8, 0) ELSE 0e0 END + 2048e0) / 4096e0) / 255e0 AS s, v8 / 255e0 AS v
  FROM (SELECT *, floor((CASE WHEN v8 = r8 THEN g8 - b8 WHEN v8 = g8 THEN b8 - r8 + 2 * d8 ELSE r8 - g8 + 4 * d8 END * CASE WHEN d8 > 0 THEN round_even(122880e0 / d8, 0) ELSE 0e0 END + 2048e0) / 4096e0) AS hh
    FROM (SELECT *, v8 - least(r8, g8, b8) AS d8 FROM (SELECT *, greatest(r8, g8, b8) AS v8 FROM (SELECT *, {truncated('r')} AS r8, {truncated('g')} AS g8, {truncated('b')} AS b8 FROM {source})))))"""


def from_hsv(source: str, keep: str = "image_id, y, x") -> str:
    """A subquery with r, g, b from h, s, v in [0, 1]."""
    table = {"r": "v q p p t v", "g": "t v v q p p", "b": "p p t v v q"}
    cols = ", ".join("round_even(CASE k " + " ".join(f"WHEN {i} THEN {'vv' if w == 'v' else w}" for i, w in enumerate(order.split())) + f" END * 255e0, 0) / 255e0 AS {c}" for c, order in table.items())
    return f"""(SELECT {keep}, {cols} FROM (SELECT *, vv * (1e0 - ss) AS p, vv * (1e0 - ss * f) AS q, vv * (1e0 - ss * (1e0 - f)) AS t
  FROM (SELECT *, h6 - floor(h6) AS f, CAST(floor(h6) AS INTEGER) % 6 AS k FROM (SELECT {keep}, {truncated('h')} / 30e0 AS h6, {truncated('s')} / 255e0 AS ss, {truncated('v')} / 255e0 AS vv FROM {source}))))"""


NORMAL = f"(SELECT image_id, y, x, r / 255e0 AS r, g / 255e0 AS g, b / 255e0 AS b FROM ({tables.PIXELS}))"


def blurred(source: str, col: str, keep: str) -> str:
    out = source
    for across, along in (("y", "x"), ("x", "y")):
        w = f"(PARTITION BY image_id, {across} ORDER BY {along})"
        out = f"(SELECT {keep}, (coalesce(lag({col}) OVER {w}, lead({col}) OVER {w}, {col}) + 2 * {col} + coalesce(lead({col}) OVER {w}, lag({col}) OVER {w}, {col})) / 4 AS {col} FROM {out})"
    return out


def otsu(source: str = NORMAL) -> str:
    return f"""(SELECT image_id, bin FROM (SELECT image_id, bin, row_number() OVER (PARTITION BY image_id ORDER BY between_ DESC, bin) AS k FROM (
  SELECT image_id, bin, n0 * (n - n0) * (s0 / n0 - CASE WHEN n - n0 > 0 THEN (s - s0) / (n - n0) ELSE s0 / n0 END) * (s0 / n0 - CASE WHEN n - n0 > 0 THEN (s - s0) / (n - n0) ELSE s0 / n0 END) AS between_
  FROM (SELECT image_id, bin, sum(c) OVER (PARTITION BY image_id ORDER BY bin) AS n0, sum(c * bin) OVER (PARTITION BY image_id ORDER BY bin) AS s0, sum(c) OVER (PARTITION BY image_id) AS n, sum(c * bin) OVER (PARTITION BY image_id) AS s
    FROM (SELECT image_id, CAST(floor(({GLI} + 1e0) / 2e0 * 255e0) AS INTEGER) AS bin, CAST(count(*) AS DOUBLE) AS c FROM {source} GROUP BY 1, 2)))) WHERE k = 1)"""


def vegetation(source: str = NORMAL) -> str:
    return f"""(SELECT image_id, otsu, coverage, p55, CASE WHEN coverage > 0.45e0 THEN greatest(p55, 0.04e0) ELSE t END AS threshold FROM (
  SELECT image_id, otsu, t, avg(CASE WHEN gli > t THEN 1e0 ELSE 0e0 END) AS coverage, quantile_cont(gli, 0.55) AS p55
  FROM (SELECT p.image_id, {GLI} AS gli, bin / 255e0 * 2e0 - 1e0 AS otsu, greatest(bin / 255e0 * 2e0 - 1e0, 0.04e0) AS t FROM {source} p JOIN {otsu(source)} o ON p.image_id = o.image_id) GROUP BY image_id, otsu, t))"""


def masks(source: str = NORMAL) -> str:
    """With h, s, v, water and vegetation."""
    hard = f"(SELECT m.*, CASE WHEN b > r AND b > g AND v < 0.5e0 AND s < 0.3e0 THEN 1e0 ELSE 0e0 END AS water, CASE WHEN {GLI} > threshold THEN 1e0 ELSE 0e0 END AS vegetation FROM {to_hsv(source)} m JOIN {vegetation(source)} t ON m.image_id = t.image_id)"
    base = "image_id, y, x, r, g, b, h, s, v"
    return blurred(blurred(hard, "water", base + ", vegetation"), "vegetation", base + ", water")


def tone_v1(source: str, b: float, c: float, s: float) -> str:
    changed = f"(SELECT image_id, y, x, h, {clip(f's * {num(1 + s)}') if s else 's'} AS s, {s_curve(gamma('v', b), c) if c else gamma('v', b)} AS v FROM {to_hsv(source)})"
    return from_hsv(changed)


def sampled(at: str, image: str, height: str, width: str, values: tuple[str, ...]) -> str:
    """Bilinear values of image at (sy, sx) of at, the edge replicated."""
    cols = ", ".join(f"round(sum(w * {v}), 6) AS {v}" for v in values)
    clamp = lambda c, n: f"CAST(least(greatest({c}, 0), {n} - 1) AS INTEGER)"
    return f"""SELECT a.y, a.x, {cols} FROM (SELECT y, x, {clamp('floor(sy) + dy', height)} AS ny, {clamp('floor(sx) + dx', width)} AS nx,
    (CASE dy WHEN 0 THEN 1e0 - (sy - floor(sy)) ELSE sy - floor(sy) END) * (CASE dx WHEN 0 THEN 1e0 - (sx - floor(sx)) ELSE sx - floor(sx) END) AS w
  FROM {at} CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS k(dy, dx)) a JOIN {image} s ON a.ny = s.y AND a.nx = s.x WHERE w > 0 GROUP BY a.y, a.x"""


def corners(source: str, extra: str = "") -> str:
    cols = []
    for k, (sx, sy) in enumerate(((-0.5, -0.5), (0.5, -0.5), (0.5, 0.5), (-0.5, 0.5)), 1):
        cols += [f"cx + width * {num(sx)} * cos(angle) - height * {num(sy)} * sin(angle) AS x{k}", f"cy + width * {num(sx)} * sin(angle) + height * {num(sy)} * cos(angle) AS y{k}"]
    return f"(SELECT *, {', '.join(cols)}{extra} FROM {source})"


def terms(p: str, l: str, h: str) -> list[str]:  # noqa: E741
    spec = "1 l p h lp lh ph ll pp hh plh lll lpp lhh llp ppp phh llh pph hhh"
    names = {"p": p, "l": l, "h": h}
    return ["1e0" if t == "1" else " * ".join(names[c] for c in t) for t in spec.split()]


def gk_forward(lon: str, lat: str, meridian: str) -> str:
    """A subquery's columns east and north over t(lon, lat, meridian), as two nested selects' text."""
    e = num(geodesy._E)
    inner = f"SELECT *, sinh(atanh(sin(radians({lat}))) - {e} * atanh({e} * sin(radians({lat})))) AS t, radians({lon} - {meridian}) AS lam"
    middle = "SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta"
    north = "xi" + "".join(f" + {num(a)} * sin({2 * k} * xi) * cosh({2 * k} * eta)" for k, a in enumerate(geodesy._ALPHA, 1))
    east = "eta" + "".join(f" + {num(a)} * cos({2 * k} * xi) * sinh({2 * k} * eta)" for k, a in enumerate(geodesy._ALPHA, 1))
    return f"SELECT *, 500000e0 + {num(geodesy._A)} * ({east}) AS east, {num(geodesy._A)} * ({north}) AS north FROM ({middle} FROM ({inner} FROM {{source}}))"
