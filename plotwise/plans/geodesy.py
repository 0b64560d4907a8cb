"""Queries over coordinates, angles and strings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.derive import ORIGIN, ctes, points, r6
from plotwise.functions import coords as c
from plotwise.functions import strings as s
from plotwise.session import table

O_LAT, O_LON = ORIGIN
QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


_ECEF = """ecef AS (SELECT *, 6378137.0::DOUBLE/sqrt(1-e2*sin(radians(lat))*sin(radians(lat))) AS nn FROM (SELECT *, 2*(1/298.257223563::DOUBLE)-(1/298.257223563::DOUBLE)*(1/298.257223563::DOUBLE) AS e2 FROM pt)),
xyz AS (SELECT *, (nn+h)*cos(radians(lat))*cos(radians(lon)) AS x, (nn+h)*cos(radians(lat))*sin(radians(lon)) AS y, (nn*(1-e2)+h)*sin(radians(lat)) AS z FROM ecef)"""
_ORIGIN = """o AS (SELECT nn*cos(la)*cos(lo) AS ox, nn*cos(la)*sin(lo) AS oy, nn*(1-e2)*sin(la) AS oz, la, lo FROM (
SELECT radians(37.23::DOUBLE) AS la, radians(-80.42::DOUBLE) AS lo, 2*(1/298.257223563::DOUBLE)-(1/298.257223563::DOUBLE)*(1/298.257223563::DOUBLE) AS e2, 6378137.0::DOUBLE/sqrt(1-(2*(1/298.257223563::DOUBLE)-(1/298.257223563::DOUBLE)*(1/298.257223563::DOUBLE))*sin(radians(37.23::DOUBLE))*sin(radians(37.23::DOUBLE))) AS nn))"""


@query("ecef_from_geodetic", ctes("pt") + f", {_ECEF} SELECT event_id, round(x,3)+0.0::DOUBLE AS x, round(y,3)+0.0::DOUBLE AS y, round(z,3)+0.0::DOUBLE AS z FROM xyz")
def ecef_from_geodetic(spark, d):
    p = points(spark, d).withColumn("e", c.geodetic_to_ecef(F.col("lat"), F.col("lon"), F.col("h")))
    return p.select("event_id", *[r6(F.col("e")[a], 3).alias(a) for a in "xyz"])


@query("enu_from_geodetic", ctes("pt") + f""", {_ECEF}, {_ORIGIN} SELECT event_id, round(-sin(lo)*(x-ox)+cos(lo)*(y-oy),3)+0.0::DOUBLE AS e,
round(-sin(la)*cos(lo)*(x-ox)-sin(la)*sin(lo)*(y-oy)+cos(la)*(z-oz),3)+0.0::DOUBLE AS n, round(cos(la)*cos(lo)*(x-ox)+cos(la)*sin(lo)*(y-oy)+sin(la)*(z-oz),3)+0.0::DOUBLE AS u FROM xyz, o""")
def enu_from_geodetic(spark, d):
    e = c.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("h"), F.lit(O_LAT), F.lit(O_LON), F.lit(0.0))
    return points(spark, d).withColumn("p", e).select("event_id", r6(F.col("p.x"), 3).alias("e"), r6(F.col("p.y"), 3).alias("n"), r6(F.col("p.z"), 3).alias("u"))


@query("geodetic_roundtrip", ctes("pt") + "SELECT event_id, round(lat,8) AS lat, round(lon,8) AS lon, round(h,4)+0.0::DOUBLE AS h FROM pt")
def geodetic_roundtrip(spark, d):
    o = (F.lit(O_LAT), F.lit(O_LON), F.lit(0.0))
    p = points(spark, d).withColumn("p", c.geodetic_to_enu(F.col("lat"), F.col("lon"), F.col("h"), *o))
    p = p.withColumn("g", c.enu_to_geodetic(F.col("p.x"), F.col("p.y"), F.col("p.z"), *o))
    return p.select("event_id", F.round("g.lat", 8).alias("lat"), F.round("g.lon", 8).alias("lon"), r6(F.col("g.h"), 4).alias("h"))


_PMOD = "(({a})-floor(({a})/({m}))*({m}))"


def _pmod(a: str, m: str) -> str:
    return _PMOD.format(a=a, m=m)


@query("heading_theta_involution", f"SELECT event_id, round({_pmod('pi()/2-value/10', '2*pi()')},6)+0.0::DOUBLE AS heading, round({_pmod('value/10', '2*pi()')},6)+0.0::DOUBLE AS theta FROM events")
def heading_theta(spark, d):
    h = c.theta_to_heading(F.col("value") / 10)
    return table(spark, d, "events").select("event_id", r6(h).alias("heading"), r6(c.theta_to_heading(h)).alias("theta"))


@query("wrap_angles", f"SELECT event_id, round({_pmod('value/7+pi()', '2*pi()')}-pi(),6)+0.0::DOUBLE AS wrapped, round({_pmod('value/7+pi()/4', 'pi()/2')}-pi()/4,6)+0.0::DOUBLE AS quarter FROM events")
def wrap_angles(spark, d):
    a = F.col("value") / 7
    return table(spark, d, "events").select("event_id", r6(c.wrap_pi(a)).alias("wrapped"), r6(c.wrap_half_pi(a)).alias("quarter"))


@query("angular_diff", f"SELECT event_id, round(abs({_pmod('value*3-user_id+180', '360.0::DOUBLE')}-180),6)+0.0::DOUBLE AS diff, round(abs({_pmod('value*3+45', '90.0::DOUBLE')}-45),6)+0.0::DOUBLE AS diff90 FROM events")
def angular_diff(spark, d):
    return table(spark, d, "events").select("event_id", r6(c.angular_diff_deg(F.col("value") * 3, F.col("user_id").cast("double"))).alias("diff"), r6(c.wrap_deg(F.col("value") * 3, 90.0)).alias("diff90"))


@query("camera_bearing", ctes("pt") + f""", m AS (SELECT *, (37.23::DOUBLE-lat)*111320.0::DOUBLE AS n, (-80.42::DOUBLE-lon)*111320.0::DOUBLE*cos(radians(37.23::DOUBLE)) AS e FROM pt)
SELECT event_id, round(CASE WHEN sqrt(e*e+n*n)<=1000 AND sqrt(e*e+n*n)>2 THEN atan2(n,e) WHEN heading<360 THEN {_pmod('pi()/2-radians(heading)', '2*pi()')} END,6)+0.0::DOUBLE AS azimuth FROM m""")
def camera_bearing(spark, d):
    a = c.camera_azimuth(F.col("lat"), F.col("lon"), F.col("heading"), F.lit(O_LAT), F.lit(O_LON))
    return points(spark, d).select("event_id", r6(a).alias("azimuth"))


@query("great_circle_bearing", ctes("pt") + f""", m AS (SELECT event_id, radians(37.23::DOUBLE) AS a, radians(lat) AS b, radians(lon-(-80.42::DOUBLE)) AS dl, lat, lon FROM pt)
SELECT event_id, round({_pmod('degrees(atan2(sin(dl)*cos(b),cos(a)*sin(b)-sin(a)*cos(b)*cos(dl)))', '360.0::DOUBLE')},6)+0.0::DOUBLE AS bearing,
round(sqrt(pow((lat-37.23::DOUBLE)*111320.0::DOUBLE,2)+pow((lon+80.42::DOUBLE)*111320.0::DOUBLE*cos(a),2)),4)+0.0::DOUBLE AS metres FROM m WHERE lat<>37.23::DOUBLE OR lon<>-80.42::DOUBLE""")
def great_circle(spark, d):
    o = (F.lit(O_LAT), F.lit(O_LON), F.col("lat"), F.col("lon"))
    return points(spark, d).where((F.col("lat") != O_LAT) | (F.col("lon") != O_LON)).select("event_id", r6(c.great_circle_bearing(*o)).alias("bearing"), r6(c.equirectangular_m(*o), 4).alias("metres"))


_KEY = " || ".join(f"(((x>>{i})&1)+2*((y>>{i})&1))::VARCHAR" for i in range(8, -1, -1))


@query("quadkey_z9", ctes("pt") + f""", t AS (SELECT event_id, least(floor((lon*4+180)/360.0::DOUBLE*512),511)::BIGINT AS x, least(floor((0.5::DOUBLE-ln((1+sin(radians(lat)))/(1-sin(radians(lat))))/(4*pi()))*512),511)::BIGINT AS y FROM (SELECT event_id, lat+h/10 AS lat, (lon+h/10)/4 AS lon FROM pt))
SELECT event_id, {_KEY} AS quadkey FROM t""")
def quadkey(spark, d):
    return points(spark, d).select("event_id", c.quadkey(F.col("lat") + F.col("h") / 10, F.col("lon") + F.col("h") / 10, 9).alias("quadkey"))


_TAG = "CASE p_partkey%7 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN p_size::VARCHAR||' m' WHEN 2 THEN p_size::VARCHAR||' ft' WHEN 3 THEN p_size::VARCHAR||'''6\"' WHEN 4 THEN p_size::VARCHAR||'''' WHEN 5 THEN p_size::VARCHAR||',5 m' ELSE p_name END"


def length_tag():
    k, n = F.col("p_partkey") % 7, F.col("p_size").cast("string")
    return F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(" m"))).when(k == 2, F.concat(n, F.lit(" ft"))).when(k == 3, F.concat(n, F.lit("'6\""))).when(k == 4, F.concat(n, F.lit("'"))).when(k == 5, F.concat(n, F.lit(",5 m"))).otherwise(F.col("p_name"))


@query("osm_length_parse", """SELECT p_partkey, round(CASE p_partkey%7 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size::DOUBLE WHEN 2 THEN p_size*0.3048::DOUBLE WHEN 3 THEN (p_size+0.5::DOUBLE)*0.3048::DOUBLE
WHEN 4 THEN p_size*0.3048::DOUBLE WHEN 5 THEN p_size+0.5::DOUBLE END,6) AS metres FROM part""")
def osm_length(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(s.parse_osm_length(length_tag()), 6).alias("metres"))


@query("names_match", """WITH a AS (SELECT p_partkey, p_name, (p_partkey%30)::VARCHAR AS number, CASE WHEN p_partkey%3=0 THEN (p_partkey%20)::VARCHAR||' main street' WHEN p_partkey%3=1 THEN 'old '||p_name||', campus' ELSE 'garden drive, '||split_part(p_name,' ',2) END AS address FROM part),
w AS (SELECT *, list_filter(string_split(lower(p_name),' '), lambda x: length(x)>3 AND x NOT IN ('hall','building','center','centre')) AS words FROM a)
SELECT p_partkey, (coalesce(regexp_extract(address,'^([0-9]+)(\\s|$)',1)=number,false) OR contains(lower(address),lower(p_name)) OR (len(words)>0 AND len(list_filter(words, lambda x: contains(lower(address),x)))=len(words))) AS matches FROM w""")
def names_match(spark, d):
    k = F.col("p_partkey")
    address = F.when(k % 3 == 0, F.concat((k % 20).cast("string"), F.lit(" main street"))).when(k % 3 == 1, F.concat(F.lit("old "), F.col("p_name"), F.lit(", campus"))).otherwise(F.concat(F.lit("garden drive, "), F.split("p_name", " ")[1]))
    return table(spark, d, "part").select("p_partkey", s.names_match(F.col("p_name"), (k % 30).cast("string"), address).alias("matches"))


@query("split_parts", """WITH q AS (SELECT DISTINCT split_part(p_name,' ',1) AS name FROM part), n AS (SELECT DISTINCT lower(p_name) AS part_name FROM part)
SELECT name, string_agg(part_name, ';' ORDER BY part_name) AS parts, count(*)::BIGINT AS n FROM q JOIN n ON starts_with(part_name, name||' ') WHERE length(name)>=4 GROUP BY name""")
def split_parts(spark, d):
    """Buildings stored in parts: names that begin with the query's name; joined on that first word, not by a scan of pairs."""
    names = table(spark, d, "part").select(F.lower("p_name").alias("part_name")).distinct().withColumn("name", F.split("part_name", " ")[0]).where(F.col("part_name").contains(" "))
    asked = table(spark, d, "part").select(F.split("p_name", " ")[0].alias("name")).distinct().where(F.length("name") >= 4)
    return asked.join(names, "name").groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("part_name")), ";").alias("parts"), F.count("*").alias("n"))


@query("prompt_denylist", """SELECT item_id, regexp_matches(text||CASE item_id%4 WHEN 0 THEN ' make it TALLER' WHEN 1 THEN ' Add a wing' ELSE ' clean sky' END,'(?i)(extend|extrude|taller|wider|add a wing|remove the roof|reshape)') AS refused FROM benchmark""")
def prompt_denylist(spark, d):
    k = F.col("item_id") % 4
    prompt = F.concat("text", F.when(k == 0, " make it TALLER").when(k == 1, " Add a wing").otherwise(" clean sky"))
    return table(spark, d, "benchmark").select("item_id", s.prompt_problem(prompt).alias("refused"))


@query("cache_slug", """SELECT p_partkey, substr(regexp_replace(lower(p_name||', '||p_type),'[^a-z0-9]','_','g'),1,48)||'_'||substr(sha256(p_name||', '||p_type),1,8) AS slug FROM part""")
def cache_slug(spark, d):
    return table(spark, d, "part").select("p_partkey", s.cache_slug(F.concat_ws(", ", "p_name", "p_type")).alias("slug"))
