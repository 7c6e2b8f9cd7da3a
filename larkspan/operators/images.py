"""Image filters on pixel relations (image_id, y, x, r, g, b), channels 0 to 1.

The formulas are this library's own definition: Rec. 709 luma for grey, HSL
for modulation, a sine curve on the largest channel for contrast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RGB = ("r", "g", "b")


def colour(text: str) -> tuple[float, float, float]:
    """(r, g, b) from "#rgb", "#rrggbb", "rgb(1,2,3)" or "rgb(10%,20%,30%)"."""
    t = text.strip().lower()
    if t.startswith("#"):
        h = t[1:]
        h = "".join(c * 2 for c in h) if len(h) == 3 else h
        if len(h) != 6:
            raise ValueError(f"not a colour: {text}")
        return tuple(int(h[k : k + 2], 16) / 255.0 for k in (0, 2, 4))
    if t.startswith("rgb(") and t.endswith(")"):
        parts = [p.strip() for p in t[4:-1].split(",")]
        if len(parts) == 3:
            return tuple(float(p[:-1]) / 100.0 if p.endswith("%") else float(p) / 255.0 for p in parts)
    raise ValueError(f"not a colour: {text}")


def _channels(df: DataFrame, f) -> DataFrame:
    return df.select(*[c for c in df.columns if c not in RGB], *[f(c, k).alias(c) for k, c in enumerate(RGB)])


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def colorize(df: DataFrame, fill: str, alpha: str) -> DataFrame:
    """Each channel moves towards the fill by that channel of alpha."""
    k, a = colour(fill), colour(alpha)
    return _channels(df, lambda c, i: F.col(c) * (1.0 - a[i]) + k[i] * a[i])


def grey(df: DataFrame) -> DataFrame:
    y = 0.212656 * F.col("r") + 0.715158 * F.col("g") + 0.072186 * F.col("b")
    return _channels(df, lambda c, i: y)


def negate(df: DataFrame, grey_only: bool = False) -> DataFrame:
    same = (F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))
    return _channels(df, lambda c, i: F.when(same, 1.0 - F.col(c)).otherwise(F.col(c)) if grey_only else 1.0 - F.col(c))


def contrast(df: DataFrame, sharpen: bool = True) -> DataFrame:
    """The brightness b (largest channel) becomes b + s/2 ((sin(pi (b - 1/2)) + 1)/2 - b), s = 1 or -1; hue and saturation stay."""
    old = F.greatest(*RGB)
    sign = 0.5 if sharpen else -0.5
    new = clamp(old + sign * (0.5 * (F.sin(F.lit(3.141592653589793) * (old - 0.5)) + 1.0) - old))
    return _channels(df, lambda c, i: F.when(old > 0, F.col(c) * new / old).otherwise(new))


def gamma(df: DataFrame, value: float) -> DataFrame:
    return _channels(df, lambda c, i: F.pow(clamp(F.col(c)), F.lit(1.0 / value)))


def modulate(df: DataFrame, brightness: float, saturation: float, hue: float) -> DataFrame:
    """Percentages of lightness and saturation in HSL; hue turns by (hue - 100)/200 of the circle."""
    high, low = F.greatest(*RGB), F.least(*RGB)
    d = high - low
    light = (high + low) / 2
    sat = F.when(d == 0, F.lit(0.0)).when(light <= 0.5, d / (high + low)).otherwise(d / (2.0 - high - low))
    r, g, b = (F.col(c) for c in RGB)
    turn = F.when(d == 0, F.lit(0.0)).when(high == r, (g - b) / d / 6.0).when(high == g, (b - r) / d / 6.0 + 1.0 / 3.0).otherwise((r - g) / d / 6.0 + 2.0 / 3.0)
    df = df.select("*", light.alias("_l"), sat.alias("_s"), turn.alias("_h"))
    df = df.select("*", clamp(F.col("_l") * (brightness / 100.0)).alias("_l2"), clamp(F.col("_s") * (saturation / 100.0)).alias("_s2"), (F.col("_h") + (hue - 100.0) / 200.0).alias("_h2")).drop("_l", "_s", "_h")
    q = F.when(F.col("_l2") <= 0.5, F.col("_l2") * (1.0 + F.col("_s2"))).otherwise(F.col("_l2") + F.col("_s2") - F.col("_l2") * F.col("_s2"))
    df = df.select("*", q.alias("_q"), (2.0 * F.col("_l2") - q).alias("_p"))

    def channel(c: str, i: int) -> Column:
        t = F.col("_h2") + (1.0 / 3.0, 0.0, -1.0 / 3.0)[i]
        t = t - F.floor(t)
        p, q = F.col("_p"), F.col("_q")
        return F.when(t * 6.0 < 1.0, p + (q - p) * 6.0 * t).when(t * 2.0 < 1.0, q).when(t * 3.0 < 2.0, p + (q - p) * (2.0 / 3.0 - t) * 6.0).otherwise(p)

    return _channels(df, channel).drop("_l2", "_s2", "_h2", "_p", "_q")


def blend(df: DataFrame, other: DataFrame, args: str) -> DataFrame:
    """"s,d": s percent of other plus d percent of df, pixel by pixel; pixels without a partner stay."""
    s, d = (float(x) / 100.0 for x in args.split(","))
    o = other.select("image_id", "y", "x", *[F.col(c).alias(f"_{c}") for c in RGB])
    joined = df.join(o, ["image_id", "y", "x"], "left")
    return _channels(joined, lambda c, i: clamp(F.when(F.col(f"_{c}").isNull(), F.col(c)).otherwise(s * F.col(f"_{c}") + d * F.col(c)))).drop(*[f"_{c}" for c in RGB])


def strips(df: DataFrame, height: int) -> DataFrame:
    return df.withColumn("strip", F.expr(f"cast(y div {height} AS int)"))


def gotham(df: DataFrame) -> DataFrame:
    out = modulate(df, 120.0, 10.0, 100.0)
    for _ in range(5):
        out = colorize(out, "#222b6d", "rgb(20%,20%,20%)")
    return contrast(contrast(gamma(out, 0.5)))


def colortone(df: DataFrame, original: DataFrame, fill: str, args: str, negated: bool) -> DataFrame:
    """One pass: blends a grey copy (negated on request) and a wholly filled copy into df.

    Both copies are pixel by pixel functions of the original, so where df has the original's pixels no join is needed.
    """
    plain = grey(original)
    plain = negate(plain, grey_only=True) if negated else plain
    return blend(blend(df, plain, args), colorize(original, fill, "#fff"), args)


def nashville(df: DataFrame, brightness: float = 100.0, saturation: float = 150.0, hue: float = 100.0, value: float = 0.7) -> DataFrame:
    """Two tone passes, then modulate and gamma. The copies are carried as columns beside the pixels, so nothing is shuffled."""
    k = colour("#222b6d")
    grey_of = 0.212656 * F.col("r") + 0.715158 * F.col("g") + 0.072186 * F.col("b")
    out = df.select("*", (1.0 - grey_of).alias("_neg"))
    for pass_ in range(2):
        tone = F.col("_neg") if pass_ == 0 else 1.0 - F.col("_neg")  # the grey copy is negated again in the second pass
        out = _channels(out, lambda c, i: clamp(0.5 * k[i] + 0.5 * clamp(0.5 * tone + 0.5 * F.col(c))))
    return gamma(modulate(out.drop("_neg"), brightness, saturation, hue), value)
