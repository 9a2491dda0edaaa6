"""Queries over the sphere: geometry, density maps, dipoles and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyloom.functions import photometry, sphere
from skyloom.operators import skymap
from skyloom.operators.resample import POISSON, sql_uniform
from skyloom.queries.registry import least_squares, query, r6, sky, sql_centres, sql_pixel, sql_place, sql_separation, table

LON, LAT = sql_place("c_custkey")
NSIDE = 8
G = sphere.GALACTIC
_XYZ = f"cos(radians({LAT})) * cos(radians({LON})) AS x, cos(radians({LAT})) * sin(radians({LON})) AS y, sin(radians({LAT})) AS z"


def _customers(spark, sf):
    return sky(spark, sf, "customer", "c_custkey")


@query("unit_vectors", f"SELECT c_custkey, round(x, 9) AS x, round(y, 9) AS y, round(z, 9) AS z FROM (SELECT c_custkey, {_XYZ} FROM customer)")
def unit_vectors(spark, sf):
    x, y, z = sphere.unit_vector(F.col("ra"), F.col("dec"))
    return _customers(spark, sf).select("c_custkey", r6(x, 9).alias("x"), r6(y, 9).alias("y"), r6(z, 9).alias("z"))


@query("icrs_to_galactic", f"SELECT c_custkey, round(degrees(asin(greatest(-1, least(1, {G[2][0]} * x + {G[2][1]} * y + {G[2][2]} * z)))), 6) AS b FROM (SELECT c_custkey, {_XYZ} FROM customer)")
def icrs_to_galactic(spark, sf):
    return _customers(spark, sf).select("c_custkey", r6(sphere.to_galactic(F.col("ra"), F.col("dec"))[1]).alias("b"))


@query("separation", f"SELECT c_custkey, round({sql_separation(LON, LAT, '266.4', '-29.0')}, 6) AS sep FROM customer")
def separation(spark, sf):
    return _customers(spark, sf).select("c_custkey", r6(sphere.separation(F.col("ra"), F.col("dec"), F.lit(266.4), F.lit(-29.0))).alias("sep"))


_PIX = sql_pixel("lon", "lat", NSIDE)
_COUNTS = f"SELECT ipix, count(*)::DOUBLE AS n, sum(c_acctbal) AS w FROM (SELECT {_PIX} AS ipix, c_acctbal FROM (SELECT {LON} AS lon, {LAT} AS lat, c_acctbal FROM customer)) GROUP BY ipix"


@query("sky_density", f"""SELECT g.ipix, coalesce(n, 0.0) AS "count", CASE WHEN n IS NULL THEN 0.0 ELSE 1.0 END AS coverage FROM (SELECT unnest(range({12 * NSIDE**2})) AS ipix) g LEFT JOIN ({_COUNTS}) c ON c.ipix = g.ipix""")
def sky_density(spark, sf):
    return skymap.density(_customers(spark, sf), NSIDE, "ra", "dec").select("ipix", "count", "coverage")


@query("density_weighted", f"""SELECT g.ipix, round(coalesce(w, 0.0), 4) AS "count" FROM (SELECT unnest(range({12 * NSIDE**2})) AS ipix) g LEFT JOIN ({_COUNTS}) c ON c.ipix = g.ipix""")
def density_weighted(spark, sf):
    return skymap.density(_customers(spark, sf), NSIDE, "ra", "dec", "c_acctbal", "observed").select("ipix", r6(F.col("count"), 4).alias("count"))


@query("vector_dipole", f"SELECT c_mktsegment, count(*) AS n, round(3 * sum(x) / count(*), 6) AS dx, round(3 * sum(y) / count(*), 6) AS dy, round(3 * sum(z) / count(*), 6) AS dz FROM (SELECT c_mktsegment, {_XYZ} FROM customer) GROUP BY 1")
def vector_dipole(spark, sf):
    d = skymap.vector_dipole(_customers(spark, sf), "ra", "dec", keys=["c_mktsegment"])
    return d.select("c_mktsegment", "n", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz")])


def _map(spark, sf):
    return skymap.mask(skymap.density(_customers(spark, sf), NSIDE, "ra", "dec", empty="observed"), gal_lat_min=15.0)


#: The masked map, and the weighted normal equations of its dipole, from pixel centres by the published formulas.
_MAP = f"""
WITH g AS (SELECT ipix, lon, z, sqrt(1 - z * z) * cos(radians(lon)) AS x, sqrt(1 - z * z) * sin(radians(lon)) AS y FROM {sql_centres(NSIDE)}),
m AS (SELECT g.ipix, x, y, z, coalesce(n, 0.0) AS n, CASE WHEN abs({G[2][0]} * x + {G[2][1]} * y + {G[2][2]} * z) >= sin(radians(15)) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS coverage FROM g LEFT JOIN ({_COUNTS}) c ON c.ipix = g.ipix),
q AS (SELECT 1 / greatest(n, 1.0) AS w, n, x, y, z FROM m WHERE coverage > 0),
s AS (SELECT sum(w) AS a, sum(w * x) AS bx, sum(w * y) AS by_, sum(w * z) AS bz, sum(w * x * x) AS cxx, sum(w * x * y) AS cxy, sum(w * x * z) AS cxz, sum(w * y * y) AS cyy, sum(w * y * z) AS cyz, sum(w * z * z) AS czz,
  sum(w * n) AS r, sum(w * x * n) AS rx, sum(w * y * n) AS ry, sum(w * z * n) AS rz, count(*)::DOUBLE AS pixels, sum(n) AS total FROM q)
"""
#: Elimination of the monopole and Cramer's rule for the rest.
_FIT = _MAP + """,
e AS (SELECT *, cxx - bx * bx / a AS xx, cxy - bx * by_ / a AS xy, cxz - bx * bz / a AS xz, cyy - by_ * by_ / a AS yy, cyz - by_ * bz / a AS yz, czz - bz * bz / a AS zz, rx - bx * r / a AS tx, ry - by_ * r / a AS ty, rz - bz * r / a AS tz FROM s),
f AS (SELECT *, yy * zz - yz * yz AS ixx, xz * yz - xy * zz AS ixy, xy * yz - xz * yy AS ixz, xx * zz - xz * xz AS iyy, xy * xz - xx * yz AS iyz, xx * yy - xy * xy AS izz, xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz) AS det FROM e),
h AS (SELECT *, (ixx * tx + ixy * ty + ixz * tz) / det AS vx, (ixy * tx + iyy * ty + iyz * tz) / det AS vy, (ixz * tx + iyz * ty + izz * tz) / det AS vz FROM f),
k AS (SELECT *, (r - bx * vx - by_ * vy - bz * vz) / a AS mono FROM h),
d AS (SELECT *, vx / mono AS x, vy / mono AS y, vz / mono AS z, sqrt(vx * vx + vy * vy + vz * vz) / mono AS amplitude FROM k),
o AS (SELECT *, sqrt((ixx * x * x + iyy * y * y + izz * z * z + 2 * (ixy * x * y + ixz * x * z + iyz * y * z)) / det) / amplitude / abs(mono) AS sigma FROM d)
SELECT round(mono, 6) AS monopole, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z, round(amplitude, 6) AS amplitude, round(sigma, 6) AS sigma, round(amplitude / sigma, 5) AS significance, round(3 / sqrt(total), 6) AS shot_noise,
  round(degrees(atan2(y, x)) - floor(degrees(atan2(y, x)) / 360) * 360, 4) AS lon, round(degrees(asin(z / amplitude)), 4) AS lat, CAST(pixels AS BIGINT) AS n_pixels FROM o
"""


def _rounded(fit):
    digits = {"significance": 5, "lon": 4, "lat": 4}
    return fit.select(*[r6(F.col(c), digits.get(c, 6)).alias(c) if t == "double" else F.col(c) for c, t in fit.dtypes])


@query("mask_coverage", _MAP + """SELECT ipix, coverage, n AS "count" FROM m""")
def mask_coverage(spark, sf):
    return _map(spark, sf).select("ipix", "coverage", "count")


@query("dipole_moments", _MAP + """SELECT CAST(k AS INTEGER) AS k, round(m, 6) AS m FROM (SELECT unnest(range(16)) AS k, unnest([a, bx, by_, bz, cxx, cxy, cxz, cyy, cyz, czz, r, rx, ry, rz, pixels, total]) AS m FROM s)""")
def dipole_moments(spark, sf):
    return skymap.dipole_moments(_map(spark, sf)).select(F.posexplode("m").alias("k", "m")).select("k", r6(F.col("m")).alias("m"))


@query("dipole_fit", _FIT)
def dipole_fit(spark, sf):
    return _rounded(skymap.dipole_fit(_map(spark, sf)))


@query("sky_density_dipole", _FIT)
def sky_density_dipole(spark, sf):
    """Density, mask and dipole fit, end to end."""
    return _rounded(skymap.dipole_fit(_map(spark, sf)))


_BY_DEGREE = [["1.0::DOUBLE"], ["x", "y", "z"], ["x * y", "y * z", "z * x", "x * x - y * y", "3 * z * z - 1"], ["x * (x * x - 3 * y * y)", "y * (3 * x * x - y * y)", "z * (x * x - y * y)", "x * y * z", "x * (5 * z * z - 1)", "y * (5 * z * z - 1)", "z * (5 * z * z - 3)"]]
_BASIS = [b for own in _BY_DEGREE for b in own]


@query("multipoles", _MAP + f""",
v AS (SELECT w, n, [{', '.join(_BASIS)}] AS v FROM q), rms AS (SELECT [{', '.join(f'sqrt(avg(v[{i}] * v[{i}]))' for i in range(1, 17))}] AS rms, count(*) AS n_pixels FROM v),
eq AS (SELECT 0 AS period, {', '.join('[' + ', '.join([*[f'sum(w * v[{i}] * v[{j}])' for j in range(1, 17)], f'sum(w * v[{i}] * n)']) + f'] AS q{i}' for i in range(1, 17))} FROM v),
{least_squares(16, "eq")}
SELECT degree::INTEGER AS degree, round(CASE degree {' '.join(f"WHEN {d} THEN " + ' + '.join(f'pow(x{i} * rms[{i}], 2)' for i in range(1 + d * d, 1 + (d + 1) ** 2)) for d in range(4))} END / pow(x1 * rms[1], 2), 6) AS power, n_pixels FROM b1, rms, (SELECT unnest(range(4)) AS degree)
""")
def multipoles(spark, sf):
    return skymap.multipoles(_map(spark, sf), 3).select("degree", r6(F.col("power")).alias("power"), "n_pixels")


def _drawn(weights: str) -> str:
    """The dipole's amplitude d of every draw; weights is a query of draw, w, n, x, y and z."""
    head, tail = _FIT.split("q AS (", 1)[0], _FIT.split("\ns AS (", 1)[1]
    sums, rest = tail.split(" FROM q)", 1)
    return f"{head}dr AS (SELECT unnest(range(50)) AS draw),\nq AS ({weights}),\ns AS (SELECT draw, {sums.removeprefix('SELECT ')} FROM q GROUP BY draw){rest.split('SELECT round(mono', 1)[0]}"


_SUMMARY = "SELECT count(*) AS draws, round(avg(amplitude), 6) AS mean, round(stddev_samp(amplitude), 6) AS sd, round(quantile_cont(amplitude, 0.16), 6) AS p16, round(quantile_cont(amplitude, 0.5), 6) AS p50, round(quantile_cont(amplitude, 0.84), 6) AS p84"
_POISSON = " + ".join(f"(u > {p!r}::DOUBLE)::INTEGER" for p in POISSON[:11])


def _short(draws):
    return draws.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in draws.dtypes])


@query("bootstrap", _drawn(f"SELECT draw, ({_POISSON}) / greatest(n, 1.0) AS w, n, x, y, z FROM (SELECT draw, m.*, {sql_uniform(1, 'draw', 'ipix')} AS u FROM m, dr WHERE coverage > 0)") + _SUMMARY + " FROM d")
def bootstrap(spark, sf):
    return _short(skymap.summary(skymap.bootstrap(_map(spark, sf), 50, 1)))


@query("null_shuffle", _drawn(f"""SELECT p.draw, 1 / greatest(v.n, 1.0) AS w, v.n, x, y, z FROM (SELECT draw, x, y, z, row_number() OVER (PARTITION BY draw ORDER BY ipix) AS k FROM m, dr WHERE coverage > 0) p
 JOIN (SELECT draw, n, row_number() OVER (PARTITION BY draw ORDER BY u, ipix) AS k FROM (SELECT draw, ipix, n, {sql_uniform(1, 'draw', 'ipix')} AS u FROM m, dr WHERE coverage > 0)) v ON v.draw = p.draw AND v.k = p.k""")
 + _SUMMARY + f", round((count(*) FILTER (amplitude >= observed) + 1) / (count(*) + 1)::DOUBLE, 6) AS p_value FROM d, (SELECT amplitude AS observed FROM ({_FIT.replace('round(amplitude, 6)', 'amplitude')}))")
def null_shuffle(spark, sf):
    m = _map(spark, sf)
    return _short(skymap.summary(skymap.null_shuffle(m, 50, 1), skymap.dipole_fit(m).first().amplitude))


@query("poisson_mocks")
def poisson_mocks(spark, sf):
    return skymap.dipole_fit(skymap.synthetic_sky(spark, 100_000, 16, 0.08, 168.0, -7.0, 3))


@query("pseudo_spectrum_dipole")
def pseudo_spectrum_dipole(spark, sf):
    return skymap.deconvolved_dipole(_map(spark, sf))


@query("hot_pixels", f"""
WITH c AS (SELECT g.ipix, coalesce(n, 0.0) AS n FROM (SELECT unnest(range({12 * NSIDE**2})) AS ipix) g LEFT JOIN ({_COUNTS}) c ON c.ipix = g.ipix),
m AS (SELECT quantile_cont(n, 0.5) AS med FROM c), d AS (SELECT quantile_cont(abs(n - med), 0.5) AS mad FROM c, m)
SELECT ipix, n AS "count" FROM c, m, d WHERE n <= med + 6 * 1.4826 * mad
""")
def hot_pixels(spark, sf):
    m = skymap.density(_customers(spark, sf), NSIDE, "ra", "dec", empty="observed")
    return skymap.clip_hot_pixels(m, rounds=1).where("coverage > 0").select("ipix", "count")


@query("kinematic_dipole", "SELECT s_suppkey, round((2 + (1 + s_suppkey % 3) * (1 + 0.75)) * 369.82 / 299792.458, 9) AS d FROM supplier")
def kinematic_dipole(spark, sf):
    slope = (1 + F.col("s_suppkey") % 3).cast("double")
    return table(spark, sf, "supplier").select("s_suppkey", r6(photometry.kinematic_dipole(F.lit(369.82), F.lit(0.75), slope), 9).alias("d"))


@query("selection_cuts", f"""
SELECT cut, count(*) AS n, round(3 * sum(x) / count(*), 6) AS dx, round(3 * sum(y) / count(*), 6) AS dy, round(3 * sum(z) / count(*), 6) AS dz
FROM (SELECT {_XYZ} FROM customer), (SELECT unnest([0, 15, 30]) AS cut) WHERE abs({G[2][0]} * x + {G[2][1]} * y + {G[2][2]} * z) >= sin(radians(cut)) GROUP BY cut
""")
def selection_cuts(spark, sf):
    """The vector dipole under several galactic latitude cuts."""
    df = _customers(spark, sf).withColumn("cut", F.explode(F.array(F.lit(0), F.lit(15), F.lit(30))))
    df = df.where(F.abs(sphere.rotate(G, sphere.unit_vector(F.col("ra"), F.col("dec")))[2]) >= F.sin(F.radians(F.col("cut").cast("double"))))
    d = skymap.vector_dipole(df, "ra", "dec", keys=["cut"])
    return d.select("cut", "n", *[r6(F.col(c)).alias(c) for c in ("dx", "dy", "dz")])


@query("compare_dipoles", f"SELECT round(f.amplitude, 6) AS measured, 0.006::DOUBLE AS expected, round(f.amplitude / 0.006, 3) AS ratio, round((f.amplitude - 0.006) / f.sigma, 3) AS tension_sigma FROM ({_FIT.replace('round(amplitude, 6)', 'amplitude').replace('round(sigma, 6)', 'sigma')}) f")
def compare_dipoles(spark, sf):
    """The measured dipole against a prediction of 0.006."""
    found = skymap.compare(skymap.dipole_fit(_map(spark, sf)), spark.createDataFrame([(0.006,)], "amplitude double"))
    return found.select(r6(F.col("measured")).alias("measured"), "expected", r6(F.col("ratio"), 3).alias("ratio"), r6(F.col("tension_sigma"), 3).alias("tension_sigma"))
