"""Water-column science: sigma layers, density, buoyancy and depths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Gravity, and the coefficients of the model's equation of state, by falling powers.
GRAVITY = 9.81
SALT = (6.76786136e-6, -4.8249614e-4, 8.14876577e-1)
SALT_ENDS = (-0.22584586, 3.895414e-2)
WARM = (1.667e-8, -8.164e-7, 1.803e-5, 0.0)
COOL = (-1.0843e-6, 9.8185e-5, -4.786e-3, 1.0)
COLDEST, SHIFT, SLOPE, POLE = 3.98, 283.0, 503.57, 67.26


def sigma_layers(spark: SparkSession, kb: int, power: float = 1.5) -> DataFrame:
    """(layer, z_top, z_bot, zz, dz) for kb levels z = -(k / (kb - 1)) ** power; zz are the middles."""
    level = lambda k: -F.pow(F.col(k) / F.lit(float(kb - 1)), F.lit(float(power)))
    rows = spark.range(1, kb).select(F.col("id").cast("int").alias("layer"), F.col("id").alias("k"), (F.col("id") - 1).alias("k0"))
    bounds = rows.select("layer", level("k0").alias("z_top"), level("k").alias("z_bot"))
    return bounds.select("*", ((F.col("z_top") + F.col("z_bot")) / 2).alias("zz"), (F.col("z_top") - F.col("z_bot")).alias("dz"))


def cubic(x, coefficients):
    """A cubic by falling powers, for columns and numbers alike."""
    a, b, c, d = coefficients
    return ((a * x + b) * x + c) * x + d


def density(t: Column, s: Column) -> Column:
    """Sigma-t of temperature and salinity, by the model's equation of state."""
    first, second = (cubic(s, (*SALT, end)) for end in SALT_ENDS)
    return (first * cubic(t, WARM) + cubic(t, COOL)) * second - F.pow(t - COLDEST, 2) * (t + SHIFT) / (SLOPE * (t + POLE))


def with_density(field: DataFrame, scale: float = 1.0) -> DataFrame:
    return field.withColumn("rho", density(F.col("temp"), F.col("salinity")) * F.lit(scale))


def layer_depth(field: DataFrame, sigma: DataFrame) -> DataFrame:
    """field (with h and zeta) and the positive depths of its layer's middle, top and bottom."""
    thick = F.col("h") + F.col("zeta")
    depths = {"depth": -thick * F.col("zz"), "depth_top": -thick * F.col("z_top"), "depth_bot": -thick * F.col("z_bot")}
    return field.join(sigma, "layer").withColumns(depths).drop("z_top", "z_bot", "zz", "dz")


def density_slope(field: DataFrame, keys: list[str], z: str = "z", rho: str = "rho") -> DataFrame:
    """field with slope, the derivative of rho by z at each layer of the shape-preserving cubic through the column.

    Closed form of the knots: a weighted harmonic mean of the secants on both sides, 0 where they differ in sign; at
    the ends the one-sided three-point slope, cut back where it would overshoot; the secant in columns of two layers.
    """
    column = Window.partitionBy(*keys).orderBy(z)
    at = lambda c, k: F.lag(c, -k).over(column) if k < 0 else F.lead(c, k).over(column)
    before = lambda c, k: F.lag(c, k).over(column)
    near = field.select("*", (at(z, 1) - F.col(z)).alias("h1"), ((at(rho, 1) - F.col(rho)) / (at(z, 1) - F.col(z))).alias("d1"))
    steps = near.select("*", before("h1", 1).alias("h0"), before("d1", 1).alias("d0"), before("h1", 2).alias("h00"), before("d1", 2).alias("d00"), at("h1", 1).alias("h2"), at("d1", 1).alias("d2"))
    c = F.col
    w1, w2 = 2 * c("h1") + c("h0"), c("h1") + 2 * c("h0")
    inner = F.when(c("d0") * c("d1") <= 0, 0.0).otherwise((w1 + w2) / (w1 / c("d0") + w2 / c("d1")))

    def end(ha: str, hb: str, da: str, db: str) -> Column:
        raw = ((2 * c(ha) + c(hb)) * c(da) - c(ha) * c(db)) / (c(ha) + c(hb))
        return F.when(c(db).isNull(), c(da)).when(raw * c(da) <= 0, 0.0).when((c(da) * c(db) <= 0) & (F.abs(raw) > 3 * F.abs(c(da))), 3 * c(da)).otherwise(raw)

    slope = F.when(c("d0").isNull(), end("h1", "h2", "d1", "d2")).when(c("d1").isNull(), end("h0", "h00", "d0", "d00")).otherwise(inner)
    return steps.withColumn("slope", slope).drop("h1", "d1", "h0", "d0", "h00", "d00", "h2", "d2")


def buoyancy(field: DataFrame, keys: list[str], how: str = "all", reference: str = "z") -> DataFrame:
    """Squared buoyancy frequency of each layer, or the largest of each column.

    field has z, negative below the surface, and rho. The density in the divisor is 1000 plus z, as the model's own
    figures have it, or 1000 plus rho with reference="rho".
    """
    slopes = density_slope(field, keys)
    n2 = -GRAVITY / (1000 + F.col(reference)) * F.col("slope")
    if how == "all":
        return slopes.withColumn("n2", n2).drop("slope")
    return slopes.groupBy(*keys).agg(F.min_by(n2, F.struct("slope", "z")).alias("n2_max"))
