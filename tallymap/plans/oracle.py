"""SQL for the same results, for an engine that knows nothing of this package.

Measures, positions and labels come from the columns the rows are generated with (line number,
place, extent), not from the GeoJSON text, so that nothing is shared with the code under check.
"""

from __future__ import annotations

import math

from tallymap.plans import sample_tables as st
from tallymap.plans.queries import BLANKS, DATE, EXPORT_LIMIT, FIRST, REQUEST_BOX, SECOND, TERRITORY, ZOOMS

GEN = st.GENERATOR_COLUMNS
TEXTS = (
    "projet", "categorie", "mo", "communes", "procedure", "date_decision", "classe", "type", "cat",
    "sscat", "duree", "si_metier", "numero_dossier",
)
FEED_TEXTS = tuple("type_mesure" if c == "type" else c for c in TEXTS)


def _ordered(columns) -> str:
    return ", ".join(f"{c} NULLS FIRST" for c in ("mesure_id", *columns, "geometry"))


_MEASURES = """CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber IN (5, 6) THEN w * h * 1.0::DOUBLE
  WHEN l_linenumber = 7 AND l_suppkey % 2 = 0 THEN w * h / 2.0::DOUBLE ELSE 0.0::DOUBLE END AS area_m2,
 CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber = 3 THEN (w + h)::DOUBLE WHEN l_linenumber = 4 THEN 2.0::DOUBLE * w
  WHEN l_linenumber = 7 THEN sqrt((w * w + h * h)::DOUBLE) ELSE 0.0::DOUBLE END AS length_m,
 CASE WHEN geometry IS NULL THEN NULL ELSE [1, 3, 3, 4, 5, 8, CASE WHEN l_suppkey % 2 = 0 THEN 7 ELSE 3 END][l_linenumber] END::BIGINT AS n_positions,
 CASE WHEN geometry IS NULL THEN NULL ELSE [1, 3, 0, 0, 0, 0, 1][l_linenumber] END::BIGINT AS n_points,
 CASE WHEN geometry IS NULL THEN NULL ELSE ['Point', 'MultiPoint', 'LineString', 'MultiLineString', 'Polygon', 'MultiPolygon', 'GeometryCollection'][l_linenumber] END AS geom_type,
 CASE WHEN geometry IS NOT NULL AND l_linenumber = 7 THEN CASE WHEN l_suppkey % 2 = 0 THEN 'LineStringPointPolygon' ELSE 'LineStringPoint' END END AS signature"""

FA = f"fa AS (SELECT *, {_MEASURES} FROM ({st.plain(st.first_publisher(extra=GEN))}))"
FB = f"fb AS (SELECT *, {_MEASURES} FROM ({st.plain(st.second_publisher(extra=GEN))}))"


def _first_pairs(column: str) -> str:
    """Pairs without repeats, by how the pairs are generated."""
    if column == "si_metier":
        one, two = "'{ONAGRE}'", "'{S3IC,ONAGRE}'"
    else:
        one, two = "'{' || l_partkey || '}'", "'{' || l_partkey || ',Z' || l_partkey || '}'"
    return f"CASE l_suppkey % 3 WHEN 0 THEN {one} WHEN 1 THEN {two} ELSE '{{}}' END"


def _feed_literal(column: str) -> str:
    return f"""CASE WHEN {column} IS NULL THEN '{{NULL}}' ELSE '{{"' || replace({column}, '+', '","') || '"}}' END"""


def _digest(columns) -> str:
    return "md5(" + " || ".join(f"coalesce(replace({c}::VARCHAR, '\"', ''), '') || '/'" if c in ("communes", "si_metier", "numero_dossier") else f"coalesce({c}::VARCHAR, '') || '/'" for c in columns) + ")"


A = f"""{FA}, a AS (SELECT *, {_digest(TEXTS)} AS md5 FROM (
 SELECT mesure_id AS num, * REPLACE ({_first_pairs('si_metier')} AS si_metier, {_first_pairs('numero_dossier')} AS numero_dossier),
  '{FIRST}' AS source, '{DATE}' AS delivery_date, 'direct' AS georef FROM fa))"""

B = f"""{FB}, b AS (SELECT *, {_digest(TEXTS)} AS md5 FROM (
 SELECT row_number() OVER (ORDER BY {_ordered(FEED_TEXTS)}) AS num, * EXCLUDE (type_mesure)
  REPLACE ({_feed_literal('communes')} AS communes, {_feed_literal('si_metier')} AS si_metier, {_feed_literal('numero_dossier')} AS numero_dossier),
  type_mesure AS type, '{SECOND}' AS source, '{DATE}' AS delivery_date, 'direct' AS georef FROM fb))"""

_BY_TOWN = """SELECT source, delivery_date, georef, CASE WHEN geometry IS NOT NULL THEN 0.0::DOUBLE END AS area_m2,
 CASE WHEN geometry IS NOT NULL THEN 0.0::DOUBLE END AS length_m, CASE WHEN geometry IS NOT NULL THEN 1::BIGINT END AS n_points,
 CASE WHEN geometry IS NOT NULL THEN 'Point' END AS geom_type, NULL::VARCHAR AS signature FROM"""

_SHORT = "source, delivery_date, georef, area_m2, length_m, n_points, geom_type, signature"

D = f"""{A}, {B}, d AS (SELECT {_SHORT} FROM a UNION ALL SELECT {_SHORT} FROM b
 UNION ALL {_BY_TOWN} (SELECT *, '{FIRST}' AS source, '{DATE}' AS delivery_date, 'commune' AS georef FROM ({st.plain(st.by_commune())}))
 UNION ALL {_BY_TOWN} (SELECT *, '{SECOND}' AS source, '{DATE}' AS delivery_date, 'commune' AS georef FROM ({st.plain(st.by_commune(dropped=True))})))"""

# Towns as text with the unknown spelled out, as the array column is shown.
_TOWNS_A = """CASE WHEN l_suppkey % 11 = 0 THEN 'NULL' WHEN l_suppkey % 5 = 0 THEN replace(replace(replace(communes, '{"', ''), '"}', ''), '","', '|') ELSE replace(replace(communes, '{', ''), '}', '') END"""
_TOWNS_B = """CASE WHEN communes = '{NULL}' THEN 'NULL' ELSE replace(replace(replace(communes, '{"', ''), '"}', ''), '","', '|') END"""
TOWNS = f"{A}, {B}, ta AS (SELECT * REPLACE ({_TOWNS_A} AS communes) FROM a), tb AS (SELECT * REPLACE ({_TOWNS_B} AS communes) FROM b)"


def _sums(name: str, table: str, keys: str) -> str:
    return f"{name} AS (SELECT {keys}, sum(area_m2) / 10000 AS area_ha, sum(length_m) / 1000 AS length_km FROM {table} GROUP BY {keys})"


PROJECTS = f"{A}, {B}, {_sums('sum_a', 'a', 'projet')}, {_sums('sum_b', 'b', 'projet')}"
TOWN_PROJECTS = f"{TOWNS}, {_sums('sum_a', 'ta', 'projet, communes')}, {_sums('sum_b', 'tb', 'projet, communes')}"


def _far(x: str, y: str) -> str:
    """More than two percent of the sum apart."""
    return f"({x} + {y} <> 0 AND abs({x} - {y}) > 0.02 * abs({x} + {y}))"


def _diff(measure: str, keys: str) -> str:
    x, y = f"sum_a.{measure}", f"sum_b.{measure}"
    return f"""SELECT {keys}, round({x}, 6) AS a_{measure}, round({y}, 6) AS b_{measure} FROM sum_a JOIN sum_b USING ({keys}) WHERE {_far(x, y)}"""


def _missing(p: str, q: str, keys: str, extra: str = "") -> str:
    """Keys of side ``p`` that side ``q`` has no full pair of measures for."""
    known = f"SELECT {keys}, area_ha, length_km FROM sum_{q}"
    return f"""SELECT {keys}, round(x.area_ha, 6) AS {p}_area_ha, round(x.length_km, 6) AS {p}_length_km,
 round(y.area_ha, 6) AS {q}_area_ha, round(y.length_km, 6) AS {q}_length_km{extra}
 FROM sum_{p} x LEFT JOIN ({known}) y USING ({keys}) WHERE y.area_ha + y.length_km IS NULL"""


# ---- projections ------------------------------------------------------------------------

_E = 0.08181919104281579
_N, _C, _R0 = 0.7256077650532686, 1.842897922402107, 6055612.049875991


def lambert_inverse(rel: str, x: str, y: str, lon: str, lat: str) -> str:
    """``rel`` with longitude and latitude of Lambert-93 columns added."""
    steps = "phi0"
    columns = "asin(tanh(_iso)) AS phi0"
    for i in range(1, 6):
        columns += f", asin(tanh(_iso + {_E} * atanh({_E} * sin(phi{i - 1})))) AS phi{i}"
        steps = f"phi{i}"
    dx, dy = f"({x} - 700000.0::DOUBLE)", f"({6600000 + _R0!r}::DOUBLE - {y})"
    return f"""(SELECT * EXCLUDE (_iso, phi0, phi1, phi2, phi3, phi4, phi5), degrees({steps}) AS {lat} FROM (SELECT *, {columns} FROM (
 SELECT *, -ln(sqrt({dx} * {dx} + {dy} * {dy}) / ({_C * 6378137.0!r}::DOUBLE)) / {_N} AS _iso, degrees(atan2({dx}, {dy}) / {_N}) + 3.0 AS {lon} FROM {rel})))"""


def utm_inverse(rel: str, x: str, y: str, lon: str, lat: str) -> str:
    n = (1 / 298.257222101) / (2 - 1 / 298.257222101)
    big_a = 6378137.0 / (1 + n) * (1 + n * n / 4 + n**4 / 64) * 0.9996
    b1, b2, b3 = n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480
    d1, d2, d3 = 2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15
    return f"""(SELECT * EXCLUDE (_xi, _eta, _x1, _e1, _chi),
  degrees(_chi + {d1!r} * sin(2 * _chi) + {d2!r} * sin(4 * _chi) + {d3!r} * sin(6 * _chi)) AS {lat},
  57.0 + degrees(atan2(sinh(_e1), cos(_x1))) AS {lon} FROM (SELECT *, asin(sin(_x1) / cosh(_e1)) AS _chi FROM (SELECT *,
  _xi - {b1!r} * sin(2 * _xi) * cosh(2 * _eta) - {b2!r} * sin(4 * _xi) * cosh(4 * _eta) - {b3!r} * sin(6 * _xi) * cosh(6 * _eta) AS _x1,
  _eta - {b1!r} * cos(2 * _xi) * sinh(2 * _eta) - {b2!r} * cos(4 * _xi) * sinh(4 * _eta) - {b3!r} * cos(6 * _xi) * sinh(6 * _eta) AS _e1
  FROM (SELECT *, ({y} - 10000000.0::DOUBLE) / {big_a!r} AS _xi, ({x} - 500000.0::DOUBLE) / {big_a!r} AS _eta FROM {rel}))))"""


def positions(source: str) -> str:
    """All positions of ``source``, one row each: row, element and place in the element."""

    def corner(x: str, y: str, element: int, place: int) -> str:
        return f"{{'px': {x}, 'py': {y}, 'el': {element}, 'o': {place}}}"

    def shape(*elements: tuple[tuple[str, str], ...]) -> str:
        return "[" + ", ".join(corner(x, y, e, o) for e, points in enumerate(elements) for o, (x, y) in enumerate(points)) + "]"

    sw, se, ne, nw = ("xi", "yi"), ("xi + w", "yi"), ("xi + w", "yi + h"), ("xi", "yi + h")
    far = (("xi + 50000", "yi"), ("xi + 50000 + w", "yi"), ("xi + 50000 + w", "yi + h"))
    cases = {
        1: shape((sw,)),
        2: shape((sw,), (se,), (ne,)),
        3: shape((sw, se, ne)),
        4: shape((sw, se), (nw, ne)),
        5: shape((sw, se, ne, nw)),
        6: shape((sw, se, ne), far),
    }
    text = " ".join(f"WHEN {k} THEN {v}" for k, v in cases.items())
    collection = f"CASE WHEN l_suppkey % 2 = 0 THEN {shape((sw,), (sw, ne), (sw, se, ne))} ELSE {shape((sw,), (sw, ne))} END"
    return f"""SELECT rid, unnest(CASE l_linenumber {text} ELSE {collection} END, recursive := true) FROM {source} WHERE geometry IS NOT NULL"""


def _placed(rel: str) -> str:
    """Rows of ``rel`` (with rid) placed in degrees: first position, box and case."""
    both = utm_inverse(lambert_inverse("(SELECT *, px::DOUBLE AS pxd, py::DOUBLE AS pyd FROM pos)", "pxd", "pyd", "lon_l", "lat_l"), "pxd", "pyd", "lon_u", "lat_u")
    return f"""r AS (SELECT *, row_number() OVER () AS rid FROM {rel}), pos AS ({positions('r')}),
 deg AS (SELECT p.rid, el, o, px, py, l_linenumber, CASE WHEN s_nationkey = 24 THEN lon_u ELSE lon_l END AS lon, CASE WHEN s_nationkey = 24 THEN lat_u ELSE lat_l END AS lat FROM {both} p JOIN r USING (rid)),
 bx AS (SELECT rid, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM deg GROUP BY rid),
 eb AS (SELECT rid, el, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM deg GROUP BY rid, el),
 g AS (SELECT r.*, bx.* EXCLUDE (rid), CASE WHEN geometry IS NULL THEN NULL WHEN s_nationkey = 24 THEN 'utm40s' ELSE 'lambert93' END AS repair_case FROM r LEFT JOIN bx USING (rid)),
 f AS (SELECT r.rid, mesure_id, num, s_nationkey, n_positions, lon, lat FROM r LEFT JOIN (SELECT rid, lon, lat FROM deg WHERE el = 0 AND o = 0) USING (rid))"""


PLACED = f"{A}, {_placed('a')}"
_PLACED_COLUMNS = "num, mesure_id, source, s_nationkey, l_linenumber, l_suppkey, xi, yi, w, h, geometry, n_positions, geom_type"
BOTH_PLACED = f"{A}, {B}, ab AS (SELECT {_PLACED_COLUMNS} FROM a UNION ALL SELECT {_PLACED_COLUMNS} FROM b), {_placed('ab')}"
WIDE = f"""fa AS (SELECT *, {_MEASURES} FROM ({st.plain(st.first_publisher(extra=GEN, **st.WIDE))})), a AS (SELECT mesure_id AS num, * FROM fa), {_placed('a')}"""

def gated(placed: str, zooms, where: str = "true") -> str:
    """How each measure is shown at each zoom, after the common tables ``placed``."""
    listed = ", ".join(map(str, zooms))
    return f"""{placed}, zm AS (SELECT unnest([{listed}]) AS zoom),
 z AS (SELECT g.*, zoom::INTEGER AS zoom, 14.0625::DOUBLE / pow(2.0::DOUBLE, zoom) AS reach,
 CASE WHEN geometry IS NULL THEN NULL WHEN geom_type = 'Point' OR zoom >= 14 OR zoom = -1 THEN 'unchanged'
  WHEN greatest(xmax - xmin, ymax - ymin) < 14.0625::DOUBLE / pow(2.0::DOUBLE, zoom) THEN 'point'
  WHEN zoom > 10 AND n_positions < 100 THEN 'unchanged' WHEN geom_type IN ('LineString', 'Polygon') THEN 'box' ELSE 'fragments' END AS display
 FROM g CROSS JOIN zm WHERE {where})"""


GATED = gated(WIDE, ZOOMS)


def _gap(p: str, q: str) -> str:
    """Distance of two boxes given by column prefixes."""
    return f"greatest(0.0, {p}xmin - {q}xmax, {q}xmin - {p}xmax, {p}ymin - {q}ymax, {q}ymin - {p}ymax)"


def _join_boxes(p: str, q: str) -> list[str]:
    return [f"least({p}xmin, {q}xmin)", f"least({p}ymin, {q}ymin)", f"greatest({p}xmax, {q}xmax)", f"greatest({p}ymax, {q}ymax)"]


_SIDES = ("xmin", "ymin", "xmax", "ymax")


def _clusters() -> str:
    """Groups of up to three elements, element after element: e0 opens g0; e1 joins it or opens g1;
    e2 joins the nearer group (the earlier of equals) or opens a group. Columns g0*, g1*, g2*."""
    picks = ", ".join(f"e{i}.{s} AS e{i}{s}" for i in range(3) for s in _SIDES)
    joined = "z JOIN eb e0 ON e0.rid = z.rid AND e0.el = 0 LEFT JOIN eb e1 ON e1.rid = z.rid AND e1.el = 1 LEFT JOIN eb e2 ON e2.rid = z.rid AND e2.el = 2"
    s0 = f"SELECT z.num, z.zoom, z.geom_type, z.reach, z.rid, {picks} FROM {joined} WHERE display = 'fragments'"
    near = f"coalesce({_gap('e0', 'e1')} < reach, false)"
    with_e1 = _join_boxes("e0", "e1")
    s1 = (
        "SELECT *, "
        + ", ".join(f"CASE WHEN e1xmin IS NOT NULL AND {near} THEN {u} ELSE e0{s} END AS h0{s}" for s, u in zip(_SIDES, with_e1))
        + ", "
        + ", ".join(f"CASE WHEN e1xmin IS NOT NULL AND NOT {near} THEN e1{s} END AS h1{s}" for s in _SIDES)
        + f" FROM ({s0})"
    )
    s2 = f"SELECT *, CASE WHEN e2xmin IS NOT NULL THEN {_gap('h0', 'e2')} END AS d0, CASE WHEN e2xmin IS NOT NULL AND h1xmin IS NOT NULL THEN {_gap('h1', 'e2')} END AS d1 FROM ({s1})"
    pick = """CASE WHEN e2xmin IS NULL THEN -1 WHEN least(d0, coalesce(d1, d0)) >= reach THEN 9 WHEN d1 IS NOT NULL AND d1 < d0 THEN 1 ELSE 0 END"""
    s3 = f"SELECT *, {pick} AS goes FROM ({s2})"
    u0, u1 = _join_boxes("h0", "e2"), _join_boxes("h1", "e2")
    return (
        "SELECT num, zoom, geom_type, reach, rid, "
        + ", ".join(f"CASE WHEN goes = 0 THEN {u} ELSE h0{s} END AS g0{s}" for s, u in zip(_SIDES, u0))
        + ", "
        + ", ".join(f"CASE WHEN goes = 1 THEN {u} ELSE h1{s} END AS g1{s}" for s, u in zip(_SIDES, u1))
        + ", "
        + ", ".join(f"CASE WHEN goes = 9 THEN e2{s} END AS g2{s}" for s in _SIDES)
        + f" FROM ({s3})"
    )


def _unfold(rel: str, p: str) -> str:
    """Groups as rows; the earliest element of group i is i, for a group opened by element i.
    A group opened by e2 while e1 joined g0 has first element 2 all the same."""
    parts = []
    for i in range(3):
        sides = ", ".join(f"{p}{i}{s} AS {s}" for s in _SIDES)
        parts.append(f"SELECT num, zoom, geom_type, reach, rid, {i}::BIGINT AS first, {sides} FROM {rel} WHERE {p}{i}xmin IS NOT NULL")
    return " UNION ALL ".join(parts)


def _merged(rel: str, p: str) -> str:
    """Up to three boxes p0..p2 merged while any two meet, as columns q0..q2. Two rounds are enough:
    the first joins a pair, the second the joined one with the third."""

    def meet(i: str, j: str) -> str:
        return f"coalesce({_gap(i, j)} = 0, false)"

    def merge(source: str, a: str, b: str, c: str, out: tuple[str, str, str], when: str) -> str:
        u = _join_boxes(a, b)
        return (
            "SELECT * EXCLUDE (" + ", ".join(f"{x}{s}" for x in (a, b, c) for s in _SIDES) + "), "
            + ", ".join(f"CASE WHEN {when} THEN {v} ELSE {a}{s} END AS {out[0]}{s}" for s, v in zip(_SIDES, u)) + ", "
            + ", ".join(f"CASE WHEN {when} THEN NULL ELSE {b}{s} END AS {out[1]}{s}" for s in _SIDES) + ", "
            + ", ".join(f"{c}{s} AS {out[2]}{s}" for s in _SIDES) + f" FROM ({source})"
        )

    def present(a: str, b: str) -> str:
        return f"({a}xmin IS NOT NULL AND {b}xmin IS NOT NULL AND {meet(a, b)})"

    q = f"SELECT * FROM {rel}"
    names = (f"{p}0", f"{p}1", f"{p}2")
    for n, (i, j) in enumerate(((0, 1), (0, 2), (1, 2), (0, 1), (0, 2))):
        k = 3 - i - j
        out = [f"m{n}_{x}" for x in range(3)]
        q = merge(q, names[i], names[j], names[k], (out[i], out[j], out[k]), present(names[i], names[j]))
        names = tuple(out)
    return (
        "SELECT num, zoom, geom_type, reach, rid, "
        + ", ".join(f"{names[x]}{s} AS q{x}{s}" for x in range(3) for s in _SIDES)
        + f" FROM ({q})"
    )


_ROUNDED_SIDES = ", ".join(f"round({s}, 7) AS {s}" for s in _SIDES)
CLUSTERS = f"{GATED}, c AS ({_clusters()})"


def fragmented(gates: str) -> str:
    return f"{gates}, c AS ({_clusters()}), k AS ({_merged('c', 'g')}), fr AS ({_unfold('k', 'q')}), n AS (SELECT rid, zoom, count(*) AS n_groups FROM fr GROUP BY rid, zoom)"


def emitted(gates: str) -> str:
    """Every fragment of every measure, after the common tables ``gates``."""
    small = "greatest(xmax - xmin, ymax - ymin) < reach"
    return f"""{fragmented(gates)}, shown AS (
 SELECT rid, num, zoom, geom_type, 0::BIGINT AS agg, display AS shape, xmin, ymin, xmax, ymax FROM z WHERE display IN ('unchanged', 'point', 'box')
 UNION ALL SELECT rid, z.num, z.zoom, z.geom_type, 0::BIGINT, 'unchanged', z.xmin, z.ymin, z.xmax, z.ymax FROM z JOIN n USING (rid, zoom) WHERE z.geom_type = 'MultiPoint' AND n_groups = 3
 UNION ALL SELECT rid, fr.num, zoom, fr.geom_type, row_number() OVER (PARTITION BY rid, zoom ORDER BY first) - 1,
  CASE WHEN {small} THEN 'point' ELSE 'box' END, xmin, ymin, xmax, ymax FROM fr JOIN n USING (rid, zoom) WHERE NOT (geom_type = 'MultiPoint' AND n_groups = 3))"""


# Symbol of what is shown: own symbol of geometries with points, the general one of small fragments.
_SYMBOL = "CASE WHEN shape = 'point' THEN 'square/3BB9FF' WHEN shape = 'unchanged' AND geom_type IN ('Point', 'MultiPoint', 'GeometryCollection') THEN 'circle/0000FF' END"
# MultiPoints alone, taken before anything is clustered.
# Points stay apart when no two of the three are nearer than the reach.
_FAR_APART = ", ".join(f"greatest(abs({p}.xmin - {q}.xmin), abs({p}.ymin - {q}.ymin))" for p, q in ("ab", "ac", "bc"))

_WIDENED = ", ".join(
    f"CASE WHEN e{i}.xmin IS NOT NULL THEN e{i}.{s} {'-' if s.endswith('min') else '+'} z.reach END AS e{i}{s}"
    for i in range(3)
    for s in _SIDES
)
WIDENED = f"""{GATED}, wd AS (SELECT z.num, z.zoom, z.geom_type, z.reach, z.rid, {_WIDENED} FROM z JOIN eb e0 ON e0.rid = z.rid AND e0.el = 0
 LEFT JOIN eb e1 ON e1.rid = z.rid AND e1.el = 1 LEFT JOIN eb e2 ON e2.rid = z.rid AND e2.el = 2 WHERE display = 'fragments'),
 mw AS ({_merged('wd', 'e')})"""

# ---- on the ellipsoid -------------------------------------------------------------------


def _q(sin_lat: str) -> str:
    e = _E
    return f"({1 - e * e!r}::DOUBLE * (({sin_lat}) / (1 - {e * e!r}::DOUBLE * ({sin_lat}) * ({sin_lat})) + atanh({e} * ({sin_lat})) / {e}))"


_Q_POLE = (1 - _E * _E) * (1 / (1 - _E * _E) + math.atanh(_E) / _E)
_FLATTENING = 1 / 298.257222101
GEODESIC = f"""WITH {PLACED}, s AS (SELECT rid, el, o, radians(lon) AS lon, atan({1 - _FLATTENING!r} * tan(radians(lat))) AS u, {_q('sin(radians(lat))')} / {_Q_POLE!r} AS s,
 CASE WHEN l_linenumber IN (3, 4) OR (l_linenumber = 7 AND el = 1) THEN 'L' WHEN l_linenumber IN (5, 6) OR (l_linenumber = 7 AND el = 2) THEN 'A' END AS kind FROM deg),
 e AS (SELECT *, s - first_value(s) OVER p AS t, lead(lon) OVER p AS lon2, lead(u) OVER p AS v, first_value(lon) OVER p AS lon0, lead(s) OVER p - first_value(s) OVER p AS t2 FROM s WINDOW p AS (PARTITION BY rid, el ORDER BY o)),
 ar AS (SELECT rid, el, abs(sum((coalesce(lon2, lon0) - lon) * (t + coalesce(t2, 0)))) / 2 * {6378137.0**2 * _Q_POLE / 2!r} AS area FROM e WHERE kind = 'A' GROUP BY rid, el),
 st AS (SELECT rid, 2 * asin(sqrt(pow(sin((v - u) / 2), 2) + cos(u) * cos(v) * pow(sin((lon2 - lon) / 2), 2))) AS sg, (u + v) / 2 AS p, (v - u) / 2 AS q FROM e WHERE kind = 'L' AND lon2 IS NOT NULL),
 ln AS (SELECT rid, sum(6378137.0 * (sg - {_FLATTENING / 2!r} * ((sg - sin(sg)) * pow(sin(p) * cos(q) / cos(sg / 2), 2) + (sg + sin(sg)) * pow(cos(p) * sin(q) / sin(sg / 2), 2)))) AS length FROM st GROUP BY rid),
 am AS (SELECT rid, sum(area) AS area FROM ar GROUP BY rid)
 SELECT projet, round(sum(CASE WHEN geometry IS NOT NULL THEN coalesce(area, 0) END) / 10000, 3) AS area_ha, round(sum(CASE WHEN geometry IS NOT NULL THEN coalesce(length, 0) END) / 1000, 3) AS length_km
 FROM r LEFT JOIN am USING (rid) LEFT JOIN ln USING (rid) GROUP BY projet"""

# ---- audited table ----------------------------------------------------------------------

FC = f"fc AS ({st.plain(st.audited())})"
FCN = f"fc AS ({st.plain(st.audited(dossiers=True))})"
_KEY = ("projet", "mo", "communes", "procedure", "type", "geometry")


def _conflicts(attribute: str, key=_KEY, label: str = "") -> str:
    on = " AND ".join(f"x.{c} = y.{c}" for c in key)
    groups = ", ".join(f"x.{c}" for c in key)
    return f"""SELECT x.projet, x.mo, x.communes, x.procedure, x.type, x.{attribute} AS value, x.c AS n_rows, sum(y.c)::BIGINT AS n_conflicting_rows,
 (x.c * sum(y.c))::BIGINT AS n_pairs{label} FROM (SELECT {', '.join(key)}, {attribute}, count(*) AS c FROM fc GROUP BY ALL) x
 JOIN (SELECT {', '.join(key)}, {attribute}, count(*) AS c FROM fc GROUP BY ALL) y ON {on} AND x.{attribute} <> y.{attribute}
 GROUP BY {groups}, x.{attribute}, x.c"""


_DEPENDENT = ("categorie", "date_decision", "classe", "cat", "sscat", "duree", "si_metier", "numero_dossier")


def _dependencies() -> str:
    parts = []
    for a in _DEPENDENT:
        parts.append(
            f"""SELECT '{a}' AS attribute, (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_KEY)} FROM fc)) AS n_keys,
 (SELECT count(*) FROM (SELECT DISTINCT {', '.join(_KEY)}, {a} FROM fc)) AS n_with_attribute,
 (SELECT count(*) FROM (SELECT {', '.join(_KEY)} FROM (SELECT DISTINCT {', '.join(_KEY)}, {a} FROM fc) GROUP BY ALL HAVING count(*) > 1)) AS n_broken"""
        )
    return "SELECT *, n_broken = 0 AS determined FROM (" + " UNION ALL ".join(parts) + ")"


# Which rows get which kind of broken shape.
_FV = f"fv AS (SELECT *, l_linenumber AS ln FROM ({st.plain(st.first_publisher(geometry=st.BROKEN_GEOMETRY, extra=GEN))}))"
_P = "ln = 5 AND geometry IS NOT NULL"
_BOW = f"({_P} AND l_partkey % 13 = 0)"
_OPEN = f"({_P} AND l_partkey % 13 <> 0 AND l_partkey % 17 = 0)"
_REPEAT = f"({_P} AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 = 0)"
_BACK = f"({_P} AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 = 0)"
_FLAT = f"({_P} AND l_partkey % 13 <> 0 AND l_partkey % 17 <> 0 AND l_partkey % 19 <> 0 AND l_partkey % 23 <> 0 AND l_partkey % 29 = 0)"
_DOT = "(ln = 3 AND geometry IS NOT NULL AND l_partkey % 13 = 0)"
_CROSSED = "(ln = 6 AND geometry IS NOT NULL AND l_partkey % 13 = 0)"
_FAR_HOLE = "(ln = 6 AND geometry IS NOT NULL AND l_partkey % 13 <> 0 AND l_partkey % 17 = 0)"
_DOUBLE = "(ln = 3 AND geometry IS NOT NULL AND l_partkey % 13 <> 0 AND l_partkey % 17 = 0)"


def _half_hull(points: str) -> str:
    """One chain of the hull of sorted positions: each new one cuts the chain at the first bend it flattens."""
    turn = "(acc[i][1] - acc[i - 1][1]) * (n[1][2] - acc[i - 1][2]) - (acc[i][2] - acc[i - 1][2]) * (n[1][1] - acc[i - 1][1])"
    keep = f"coalesce(list_min([i FOR i IN range(2, len(acc) + 1) IF {turn} <= 0]) - 1, len(acc))"
    return f"list_reduce([[q] FOR q IN {points}], lambda acc, n: list_concat(acc[:{keep}], n))"


def _rule(name: str, test: str) -> str:
    return f"SELECT '{name}' AS rule, count_if({test})::BIGINT AS violations FROM fv"


# ---- business ---------------------------------------------------------------------------

BIZ = st.business_with()
_UNKNOWN = "Durée non définie dans l''acte"
_LABEL = f"CASE WHEN amount IS NULL OR unit IS NULL THEN '{_UNKNOWN}' ELSE floor(amount + 0.5)::BIGINT || ' ' || unit || '(s)' END"
_TIMED = "timed AS (SELECT d_mesures.*, duree_prescrite_realisation AS amount, d_unites.nom AS unit FROM d_mesures LEFT JOIN d_unites ON d_unites.id = duree_unite_id)"
# Every attribute of a measure but its place, step by step: project, act, dossiers, class.
_ATTRIBUTES = "projet, categorie, mo, procedure, date_decision, classe, type, cat, sscat, duree, si_metier, numero_dossier"
FLAT = f"""{BIZ}, {_TIMED},
 owner AS (SELECT d_adresses.id AS maitrise_ouvrage_adresse_id, d_ouvrages.nom AS mo FROM d_adresses LEFT JOIN d_ouvrages ON d_ouvrages.id = maitrise_ouvrage_id),
 topic AS (SELECT id AS projet_categorie_id, libelle AS categorie FROM d_eurovoc WHERE id IN (SELECT id FROM d_projet_categories)),
 project AS (SELECT id AS projet_id, nom AS projet, categorie, mo, projet_categorie_id IN (SELECT projet_categorie_id FROM topic) AS has_topic
  FROM d_projets LEFT JOIN topic USING (projet_categorie_id) LEFT JOIN owner USING (maitrise_ouvrage_adresse_id)),
 act AS (SELECT d_procedures.id AS procedure_id, date_decision, d_procedure_types.nom AS procedure, project.*
  FROM d_procedures JOIN project USING (projet_id) LEFT JOIN d_procedure_types ON d_procedure_types.id = procedure_type_id),
 dossier AS (SELECT procedure_id, numero_dossier, d_reference_types.nom AS si_metier FROM d_procedure_references LEFT JOIN d_reference_types ON d_reference_types.id = reference_type_id),
 flat AS (SELECT timed.id AS mesure_id, has_topic, {_LABEL} AS duree, projet, categorie, mo, procedure, date_decision, k.classe, k.type, k.cat, k.sscat, si_metier, numero_dossier
  FROM timed JOIN d_classification k ON k.id = mesure_categorie_id AND k.classe = 'Compensation' JOIN act USING (procedure_id) LEFT JOIN dossier USING (procedure_id)),
 town AS (SELECT mesure_id, nom AS commune, cx, cy FROM d_communes_mesures JOIN d_communes ON d_communes.id = commune_id)"""

_COMPENSATION = "comp AS (SELECT x.*, code, x.id IN (SELECT mesure_id FROM d_emprises_mesures) AS drawn FROM d_mesures x JOIN d_mesure_categories c ON c.id = x.mesure_categorie_id)"
_IS_C = "code LIKE 'C%'"
_LEVEL = "['Classe', 'Type', 'sous-categorie'][least(length(code), 3)]"
_YEARS = f", {_COMPENSATION} SELECT year(date_decision)::BIGINT AS annee, count(*) AS nb_mesures FROM comp JOIN d_procedures ON d_procedures.id = procedure_id WHERE {_IS_C} GROUP BY 1"
_PROJECT_TOWNS = f"""{BIZ}, pt AS (SELECT projet_id, d_communes.nom FROM d_mesures JOIN d_communes_mesures ON mesure_id = d_mesures.id
 JOIN d_communes ON d_communes.id = commune_id JOIN d_procedures ON d_procedures.id = procedure_id)"""


def _repeated(name: str) -> str:
    return f"'{{' || string_agg(coalesce({name}, 'NULL'), ',' ORDER BY {name} NULLS LAST) || '}}'"


# ---- feed and attributes ----------------------------------------------------------------

_LAYER = "CASE WHEN geometry IS NOT NULL AND l_linenumber IN (1, 2) THEN 'emprises_ponctuelles' WHEN geometry IS NOT NULL AND l_linenumber IN (3, 4) THEN 'emprises_lineaires' ELSE 'emprises_polygones' END"
_LAYER_RANK = "CASE layer WHEN 'emprises_polygones' THEN 1 WHEN 'emprises_lineaires' THEN 2 ELSE 3 END"
_FEED_LIST = ", ".join(("mesure_id", *FEED_TEXTS, "geometry"))
_FEED_LIST_TEXT = ", ".join(f"{c}::VARCHAR AS {c}" if c == "date_decision" else c for c in ("mesure_id", *FEED_TEXTS, "geometry"))


def _attribute(name: str, x: str, y: str, form: str) -> str:
    left = f"(SELECT DISTINCT projet, ({x})::VARCHAR AS v FROM fa)"
    right = f"(SELECT DISTINCT projet, ({y})::VARCHAR AS v FROM fb)"
    return f"""SELECT '{name}' AS attribute, count(*) AS projects, count_if(oa > 0 OR ob > 0)::BIGINT AS projects_differing, sum(oa)::BIGINT AS values_only_a,
 sum(ob)::BIGINT AS values_only_b, '{form}' AS form FROM (SELECT projet, count_if(ia AND ib IS NULL) AS oa, count_if(ib AND ia IS NULL) AS ob, count(ia) AS na, count(ib) AS nb
 FROM (SELECT coalesce(l.projet, q.projet) AS projet, l.ia, q.ib FROM (SELECT *, true AS ia FROM {left}) l
  FULL JOIN (SELECT *, true AS ib FROM {right}) q ON l.projet = q.projet AND l.v IS NOT DISTINCT FROM q.v) GROUP BY projet) WHERE na > 0 AND nb > 0"""


def _attributes() -> str:
    parts = []
    # One form: sorted items in quotes.
    sorted_towns = {
        "a": """CASE WHEN l_suppkey % 11 = 0 THEN '{NULL}' WHEN l_suppkey % 5 = 0 THEN communes ELSE '{"' || replace(replace(communes, '{', ''), '}', '') || '"}' END""",
        "b": """CASE WHEN communes IS NULL THEN '{NULL}' ELSE '{"' || replace(communes, '+', '","') || '"}' END""",
    }
    sorted_si = {
        "a": """CASE l_suppkey % 3 WHEN 0 THEN '{"ONAGRE"}' WHEN 1 THEN '{"ONAGRE","S3IC"}' ELSE '{}' END""",
        "b": """CASE l_suppkey % 3 WHEN 0 THEN '{"ONAGRE"}' WHEN 1 THEN '{"ONAGRE","S3IC"}' ELSE '{NULL}' END""",
    }
    sorted_num = {
        "a": """CASE l_suppkey % 3 WHEN 0 THEN '{"' || l_partkey || '"}' WHEN 1 THEN '{"' || l_partkey || '","Z' || l_partkey || '"}' ELSE '{}' END""",
        "b": """CASE l_suppkey % 3 WHEN 0 THEN '{"' || l_partkey || '"}' WHEN 1 THEN '{"' || l_partkey || '","Z' || l_partkey || '"}' ELSE '{NULL}' END""",
    }
    one_form = {"communes": sorted_towns, "si_metier": sorted_si, "numero_dossier": sorted_num}
    for c in TEXTS:
        if c == "projet":
            continue
        other = "type_mesure" if c == "type" else c
        parts.append(_attribute(c, c, other, "delivered"))
        form = one_form.get(c)
        parts.append(_attribute(c, form["a"] if form else c, form["b"] if form else other, "repaired"))
    return " UNION ALL ".join(parts)


_PROFILE = [("mesure_id", "bigint", False)] + [
    (c, "date" if c == "date_decision" else "string", False) for c in TEXTS
] + [("geometry", "geometry", True)]

_BOXES = """{n} AS (SELECT xi::DOUBLE AS xmin, yi::DOUBLE AS ymin,
 CASE l_linenumber WHEN 1 THEN xi WHEN 6 THEN xi + 50000 + w ELSE xi + w END::DOUBLE AS xmax,
 CASE l_linenumber WHEN 1 THEN yi ELSE yi + h END::DOUBLE AS ymax, count(*) AS n FROM ({rows}) WHERE geometry IS NOT NULL GROUP BY ALL)"""
BOXED = (
    _BOXES.format(n="ba", rows=st.plain(st.first_publisher(extra=GEN, y=st.GROWING_TERRITORY)))
    + ", "
    + _BOXES.format(n="bb", rows=st.plain(st.second_publisher(extra=GEN, y=st.GROWING_TERRITORY)))
)
_MEET = "ba.ymin <= bb.ymax AND ba.ymax >= bb.ymin AND ba.xmin <= bb.xmax AND ba.xmax >= bb.xmin"
_COMMON = "(least(ba.xmax, bb.xmax) - greatest(ba.xmin, bb.xmin)) * (least(ba.ymax, bb.ymax) - greatest(ba.ymin, bb.ymin))"
_A_SIDES = ", ".join(f"ba.{s} AS a_{s}" for s in _SIDES)
_B_SIDES = ", ".join(f"bb.{s} AS b_{s}" for s in _SIDES)

_XMIN, _YMIN, _XMAX, _YMAX = REQUEST_BOX
_TX0, _TY0, _TX1, _TY1 = TERRITORY

ORACLE: dict[str, str] = {
    "scan_delivery": f"""WITH {TOWNS} SELECT num, projet, mo, communes, date_decision, duree, md5, geom_type, n_positions,
 round(area_m2 / 10000, 6) AS area_ha, round(length_m / 1000, 6) AS length_km FROM ta""",
    "list_deliveries": f"""WITH {D} SELECT DISTINCT 'mce' || source || delivery_date || georef AS table_name, source, delivery_date, georef FROM d""",
    "read_feature_pages": f"""WITH {FB}, l AS (SELECT *, {_LAYER} AS layer FROM fb)
 SELECT layer, row_number() OVER (ORDER BY {_LAYER_RANK}, {_ordered(FEED_TEXTS)}) AS num, {_FEED_LIST_TEXT} FROM l""",
    "load_feed_pages": f"""WITH {FB}, l AS (SELECT *, {_LAYER} AS layer FROM fb)
 SELECT row_number() OVER (ORDER BY {_LAYER_RANK}, {_ordered(FEED_TEXTS)}) AS num, mesure_id, projet, type_mesure AS type, geom_type, 'webmercator' AS repair_case, round(area_m2, 6) AS area_m2,
 CASE WHEN geometry IS NOT NULL THEN round(degrees(xi / 6378137.0::DOUBLE), 7) END AS lon,
 CASE WHEN geometry IS NOT NULL THEN round(degrees(2 * atan(exp(yi / 6378137.0::DOUBLE)) - {math.pi / 2!r}), 7) END AS lat FROM l""",
    "audit_page_completeness": f"""WITH {FB}, l AS (SELECT {_LAYER} AS layer, count(*) AS n FROM fb GROUP BY 1)
 SELECT layer, n AS announced, n AS features, ceil(n / 1000.0)::BIGINT AS pages, CASE WHEN n % 1000 = 0 THEN 1 ELSE 0 END::BIGINT AS empty_pages,
 ceil(n / 1000.0)::BIGINT AS pages_needed, true AS complete FROM l""",
    "stream_feature_pages": f"""WITH {FB} SELECT {_LAYER} AS layer, count(*) AS features, sum(mesure_id)::BIGINT AS sum_mesure_id, count(DISTINCT projet) AS projects FROM fb GROUP BY 1""",
    "read_copy_dump": f"WITH {FA} SELECT {', '.join(TEXTS)} FROM fa",
    "read_dump_blocks": f"WITH {FA} SELECT mesure_id, communes, duree FROM fa",
    "decode_ewkb_points": f"""WITH {FA} SELECT projet, numero_dossier, CASE WHEN geometry IS NOT NULL THEN xi + w / 64.0::DOUBLE END AS x,
 CASE WHEN geometry IS NOT NULL THEN yi - h / 128.0::DOUBLE END AS y FROM fa""",
    "read_geojson_table": f"""WITH {FA} SELECT projet, communes, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM fa GROUP BY ALL""",
    "load_overwrite": f"""WITH {A}, {B}, u AS (SELECT source, georef, num, projet, si_metier, numero_dossier, md5, s_nationkey, geometry, area_m2 FROM a
 UNION ALL SELECT source, georef, num, projet, si_metier, numero_dossier, md5, s_nationkey, geometry, area_m2 FROM b)
 SELECT * EXCLUDE (s_nationkey, geometry), CASE WHEN geometry IS NULL THEN NULL WHEN s_nationkey = 24 THEN 'utm40s' ELSE 'lambert93' END AS repair_case FROM u""",
    "write_geojson": f"WITH {A} SELECT projet, geom_type, count(*) AS features, sum(n_positions)::BIGINT AS positions FROM a WHERE geometry IS NOT NULL GROUP BY ALL",
    "write_csv_report": f"WITH {BIZ}{_YEARS}",
    "table_profile": f"WITH {FA} " + " UNION ALL ".join(
        f"SELECT {i}::BIGINT AS position, '{n}' AS name, '{t}' AS data_type, {str(geo).lower()} AS is_geometry, count(*) AS n_rows, count_if({n} IS NULL)::BIGINT AS n_nulls FROM fa"
        for i, (n, t, geo) in enumerate(_PROFILE, start=1)
    ),
    "parse_pg_array": f"""WITH {FA} SELECT mesure_id, CASE WHEN l_suppkey % 11 <> 0 AND l_suppkey % 5 = 0 THEN 2 ELSE 1 END::BIGINT AS n,
 split_part({_TOWNS_A.replace("'NULL'", 'NULL')}, '|', 1) AS first_item,
 CASE WHEN l_suppkey % 11 <> 0 AND l_suppkey % 5 = 0 THEN split_part({_TOWNS_A}, '|', 2) END AS second_item,
 CASE WHEN l_suppkey % 11 = 0 THEN '{{NULL}}' ELSE '{{"' || replace({_TOWNS_A}, '|', '","') || '"}}' END AS literal FROM fa""",
    "normalise_plus_arrays": f"WITH {FB} SELECT mesure_id, {_feed_literal('communes')} AS communes, {_feed_literal('si_metier')} AS si_metier, {_feed_literal('numero_dossier')} AS numero_dossier FROM fb",
    "rename_feed_columns": f"WITH {FB} SELECT mesure_id, type_mesure AS type, cat FROM fb",
    "dedupe_paired_arrays": f"WITH {FA} SELECT mesure_id, {_first_pairs('si_metier')} AS si_metier, {_first_pairs('numero_dossier')} AS numero_dossier FROM fa",
    "falsy_to_null": f"SELECT mesure_id, CASE WHEN value NOT IN ('', '0') THEN value END AS value FROM ({st.plain(BLANKS)})",
    "assign_num": f"""WITH {FA}, k AS (SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN mesure_id END AS mesure_id) FROM fa)
 SELECT coalesce(mesure_id, row_number() OVER (ORDER BY {_ordered(TEXTS)})) AS num, mesure_id, projet, numero_dossier FROM k""",
    "fingerprint_md5": f"WITH {A} SELECT mesure_id, md5 FROM a",
    "duration_label": f"WITH {BIZ}, {_TIMED} SELECT id, {_LABEL} AS duree FROM timed",
    "classify_level": f"WITH {BIZ}, {_COMPENSATION} SELECT id, code, {_LEVEL} AS level FROM comp",
    "filter_compensation": f"WITH {BIZ}, {_COMPENSATION} SELECT id, code FROM comp WHERE {_IS_C}",
    "lookup_measure": f"WITH {A} SELECT num, projet, md5, geom_type, n_positions FROM a WHERE num = (SELECT min(num) FROM a)",
    "bbox_filter": f"WITH {PLACED} SELECT num, projet, geom_type FROM g WHERE xmin <= {_XMAX} AND xmax >= {_XMIN} AND ymin <= {_YMAX} AND ymax >= {_YMIN}",
    "feature_properties": f"""WITH {A} SELECT n_positions AS "nbreOfPos", num, projet, duree, CASE WHEN area_m2 <> 0 THEN round(area_m2 / 10000, 2) END AS area_ha,
 CASE WHEN length_m <> 0 THEN round(length_m / 1000, 2) END AS length_km FROM a WHERE geometry IS NOT NULL""",
    "listing_view": f"""WITH {A} SELECT mesure_id, projet, date_decision, duree, md5, CASE WHEN area_m2 <> 0 THEN printf('%.2f', round(area_m2 / 10000, 2)) ELSE '' END AS area_ha,
 CASE WHEN length_m <> 0 THEN printf('%.2f', round(length_m / 1000, 2)) ELSE '' END AS length_km FROM a""",
    "set_srid_census": f"WITH {BIZ} SELECT srid::BIGINT AS srid, count(*) AS nbre, 2154::BIGINT AS forced_srid FROM d_emprises GROUP BY 1",
    "drop_z": f"""WITH h AS (SELECT l_orderkey * 8 + l_linenumber AS mesure_id, x, y, x2, y2 FROM ({st.plain(st.base())}))
 SELECT mesure_id, '{{"type":"LineString","coordinates":[[' || x || '.0,' || y || '.0],[' || x2 || '.0,' || y2 || '.0]]}}' AS flat, 2::BIGINT AS n FROM h""",
    "round_coords": f"WITH {PLACED} SELECT num, round(lon, 4) AS lon, round(lat, 4) AS lat, n_positions FROM f",
    "reproject_lambert93": f"WITH {FA} SELECT mesure_id, CASE WHEN geometry IS NOT NULL THEN round(lon, 7) END AS lon, CASE WHEN geometry IS NOT NULL THEN round(lat, 7) END AS lat FROM {lambert_inverse('fa', 'xi', 'yi', 'lon', 'lat')}",
    "project_lambert93": f"""WITH {FA} SELECT mesure_id, CASE WHEN geometry IS NOT NULL THEN xi::DOUBLE END AS xmin, CASE WHEN geometry IS NOT NULL THEN yi::DOUBLE END AS ymin,
 CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber = 1 THEN xi WHEN l_linenumber = 6 THEN xi + 50000 + w ELSE xi + w END::DOUBLE AS xmax,
 CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber = 1 THEN yi ELSE yi + h END::DOUBLE AS ymax FROM fa""",
    "reproject_utm40s": f"WITH {FA} SELECT mesure_id, CASE WHEN geometry IS NOT NULL THEN round(lon, 7) END AS lon, CASE WHEN geometry IS NOT NULL THEN round(lat, 7) END AS lat FROM {utm_inverse('fa', 'xi', 'yi', 'lon', 'lat')}",
    "reproject_webmercator": f"""WITH {FA} SELECT mesure_id, CASE WHEN geometry IS NOT NULL THEN round(degrees(xi / 6378137.0::DOUBLE), 7) END AS lon,
 CASE WHEN geometry IS NOT NULL THEN round(degrees(2 * atan(exp(yi / 6378137.0::DOUBLE)) - {math.pi / 2!r}), 7) END AS lat FROM fa""",
    "repair_projection": f"""WITH {PLACED} SELECT 'metres' AS input, mesure_id, CASE WHEN lon IS NULL THEN NULL WHEN s_nationkey = 24 THEN 'utm40s' ELSE 'lambert93' END AS repair_case, round(lon, 7) AS lon, round(lat, 7) AS lat FROM f
 UNION ALL SELECT 'degrees', mesure_id, CASE WHEN lon IS NULL THEN NULL WHEN s_nationkey = 24 THEN 'utm40s_as_lambert93' ELSE 'lonlat' END, round(lon, 7), round(lat, 7) FROM f""",
    "audit_extent": f"WITH {PLACED} SELECT repair_case, count(*) AS nbre, count(*) FILTER (NOT (xmin >= {_TX0} AND ymin >= {_TY0} AND xmax <= {_TX1} AND ymax <= {_TY1})) AS outside FROM g GROUP BY 1",
    "area_ha": f"WITH {FA} SELECT mesure_id, round(area_m2 / 10000, 6) AS area_ha FROM fa",
    "length_km": f"WITH {FA} SELECT mesure_id, round(length_m / 1000, 6) AS length_km FROM fa",
    "count_positions": f"WITH {FA} SELECT mesure_id, n_positions FROM fa",
    "geometry_bbox": f"""WITH {FA}, b AS (SELECT mesure_id, CASE WHEN geometry IS NOT NULL THEN xi::DOUBLE END AS xmin, CASE WHEN geometry IS NOT NULL THEN yi::DOUBLE END AS ymin,
 CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber = 1 THEN xi WHEN l_linenumber = 6 THEN xi + 50000 + w ELSE xi + w END::DOUBLE AS xmax,
 CASE WHEN geometry IS NULL THEN NULL WHEN l_linenumber = 1 THEN yi ELSE yi + h END::DOUBLE AS ymax FROM fa)
 SELECT *, (xmin + xmax) / 2 AS center_x, (ymin + ymax) / 2 AS center_y, greatest(xmax - xmin, ymax - ymin) AS size FROM b""",
    "viewport": f"""WITH {PLACED} SELECT num, round((xmin + xmax) / 2, 7) AS lon, round((ymin + ymax) / 2, 7) AS lat,
 CASE WHEN greatest(xmax - xmin, ymax - ymin) = 0 THEN 18 ELSE greatest(0, least(18, floor(log2(360.0 / greatest(xmax - xmin, ymax - ymin))))) END::BIGINT AS zoom FROM g WHERE geometry IS NOT NULL""",
    "geometry_types": f"WITH {D} SELECT source, delivery_date, georef, geom_type, count(*) AS nbre FROM d WHERE geom_type IS NOT NULL GROUP BY ALL",
    "dissolve_collections": f"""WITH {FA}, n AS (SELECT mesure_id, l_suppkey, geom_type, n_positions FROM fa WHERE geometry IS NOT NULL)
 SELECT mesure_id, 0::BIGINT AS member, geom_type, n_positions FROM n WHERE geom_type <> 'GeometryCollection'
 UNION ALL SELECT mesure_id, 0::BIGINT, 'Point', 1::BIGINT FROM n WHERE geom_type = 'GeometryCollection'
 UNION ALL SELECT mesure_id, 1::BIGINT, 'LineString', 2::BIGINT FROM n WHERE geom_type = 'GeometryCollection'
 UNION ALL SELECT mesure_id, 2::BIGINT, 'Polygon', 4::BIGINT FROM n WHERE geom_type = 'GeometryCollection' AND l_suppkey % 2 = 0""",
    "decompose_elements": f"""WITH {FA}, e AS (SELECT mesure_id, unnest(CASE l_linenumber WHEN 1 THEN [{{'el': 0, 'kind': 'P', 'n': 1}}]
 WHEN 2 THEN [{{'el': 0, 'kind': 'P', 'n': 1}}, {{'el': 1, 'kind': 'P', 'n': 1}}, {{'el': 2, 'kind': 'P', 'n': 1}}] WHEN 3 THEN [{{'el': 0, 'kind': 'L', 'n': 3}}]
 WHEN 4 THEN [{{'el': 0, 'kind': 'L', 'n': 2}}, {{'el': 1, 'kind': 'L', 'n': 2}}] WHEN 5 THEN [{{'el': 0, 'kind': 'A', 'n': 5}}]
 WHEN 6 THEN [{{'el': 0, 'kind': 'A', 'n': 4}}, {{'el': 1, 'kind': 'A', 'n': 4}}]
 ELSE CASE WHEN l_suppkey % 2 = 0 THEN [{{'el': 0, 'kind': 'P', 'n': 1}}, {{'el': 1, 'kind': 'L', 'n': 2}}, {{'el': 2, 'kind': 'A', 'n': 4}}] ELSE [{{'el': 0, 'kind': 'P', 'n': 1}}, {{'el': 1, 'kind': 'L', 'n': 2}}] END END) AS s FROM fa WHERE geometry IS NOT NULL)
 SELECT mesure_id, s.el::BIGINT AS element, s.kind AS kind, s.n::BIGINT AS n_positions FROM e""",
    "convex_hull": f"""WITH {FA} SELECT mesure_id, CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 3 WHEN 3 THEN 3 WHEN 4 THEN 4 WHEN 5 THEN 4 WHEN 6 THEN 4 ELSE CASE WHEN l_suppkey % 2 = 0 THEN 3 ELSE 2 END END::BIGINT AS n_corners,
 CASE l_linenumber WHEN 1 THEN 0 WHEN 2 THEN w * h / 2.0 WHEN 3 THEN w * h / 2.0 WHEN 4 THEN w * h WHEN 5 THEN w * h WHEN 6 THEN h * (100000.0 + w) / 2 ELSE CASE WHEN l_suppkey % 2 = 0 THEN w * h / 2.0 ELSE 0 END END::DOUBLE AS area_m2
 FROM fa WHERE geometry IS NOT NULL""",
    "convex_hull_by_project": f"""WITH {FA}, pts AS (SELECT projet, unnest(CASE l_linenumber WHEN 1 THEN [[xi, yi]] WHEN 2 THEN [[xi, yi], [xi + w, yi], [xi + w, yi + h]] WHEN 3 THEN [[xi, yi], [xi + w, yi], [xi + w, yi + h]]
  WHEN 4 THEN [[xi, yi], [xi + w, yi], [xi, yi + h], [xi + w, yi + h]] WHEN 5 THEN [[xi, yi], [xi + w, yi], [xi, yi + h], [xi + w, yi + h]]
  WHEN 6 THEN [[xi, yi], [xi + w, yi], [xi + w, yi + h], [xi + 50000, yi], [xi + 50000 + w, yi], [xi + 50000 + w, yi + h]]
  ELSE CASE WHEN l_suppkey % 2 = 0 THEN [[xi, yi], [xi + w, yi + h], [xi + w, yi]] ELSE [[xi, yi], [xi + w, yi + h]] END END) AS p FROM fa WHERE geometry IS NOT NULL),
 s AS (SELECT projet, list_sort(list(DISTINCT [p[1]::BIGINT, p[2]::BIGINT])) AS p FROM pts GROUP BY projet),
 c AS (SELECT projet, p, {_half_hull('p')} AS lower, {_half_hull('list_reverse(p)')} AS upper FROM s),
 h AS (SELECT projet, CASE WHEN len(p) <= 2 THEN p ELSE lower[:-2] || upper[:-2] END AS hull FROM c)
 SELECT projet, len(hull) AS n_corners, CASE WHEN len(hull) < 3 THEN 0.0 ELSE abs(list_sum([hull[i][1] * hull[i % len(hull) + 1][2] - hull[i % len(hull) + 1][1] * hull[i][2] FOR i IN range(1, len(hull) + 1)]))::DOUBLE / 2 END AS area_m2 FROM h""",
    "geometry_md5": f"WITH {FA} SELECT n_rows, geometry IS NULL AS no_shape, count(*) AS n_shapes FROM (SELECT geometry, count(*) AS n_rows FROM fa GROUP BY geometry) GROUP BY ALL",
    "audit_validity": f"WITH {_FV} {_rule('open_ring', _OPEN)} UNION ALL {_rule('short_ring', _FLAT)} UNION ALL {_rule('short_line', _DOT)} UNION ALL {_rule('repeated_position', f'{_REPEAT} OR {_DOUBLE}')} UNION ALL {_rule('self_crossing', _BOW)}"
    + f" UNION ALL {_rule('crossing_rings', _CROSSED)} UNION ALL {_rule('hole_outside', _FAR_HOLE)} UNION ALL {_rule('nested_holes', 'false')} UNION ALL {_rule('nested_polygons', 'false')}",
    "repair_geometry": f"""WITH {_FV}, s AS (SELECT *, {_MEASURES} FROM fv)
 SELECT geom_type, CASE WHEN geometry IS NULL THEN NULL WHEN {_FLAT} OR {_DOT} THEN 'dropped' WHEN {_OPEN} OR {_REPEAT} OR {_DOUBLE} THEN 'repaired' ELSE 'ok' END AS shape_status,
 count(*) AS n, sum(CASE WHEN {_FLAT} OR {_DOT} THEN NULL WHEN {_DOUBLE} THEN 2 ELSE n_positions END)::BIGINT AS positions FROM s GROUP BY 1, 2""",
    "audit_negative_area": f"WITH {_FV} SELECT mesure_id, (w * h)::DOUBLE AS area_m2, -(w * h)::DOUBLE AS signed_m2 FROM fv WHERE {_BACK}",
    "diff_area": f"WITH {PROJECTS} {_diff('area_ha', 'projet')}",
    "diff_length": f"WITH {PROJECTS} {_diff('length_km', 'projet')}",
    "missing_in_b": f"WITH {PROJECTS} {_missing('a', 'b', 'projet')}",
    "missing_in_a": f"WITH {PROJECTS} {_missing('b', 'a', 'projet')}",
    "diff_area_by_communes": f"WITH {TOWN_PROJECTS} {_diff('area_ha', 'projet, communes')}",
    "diff_length_by_communes": f"WITH {TOWN_PROJECTS} {_diff('length_km', 'projet, communes')}",
    "missing_by_communes": "WITH " + TOWN_PROJECTS + " SELECT * FROM (" + _missing("a", "b", "projet, communes", ", 'b' AS missing_in") + ") UNION ALL BY NAME SELECT * FROM (" + _missing("b", "a", "projet, communes", ", 'a' AS missing_in") + ")",
    "missing_totals": f"""WITH {TOWN_PROJECTS} SELECT round(sum(area_ha), 6) AS area_ha, round(sum(length_km), 6) AS length_km FROM sum_a x
 WHERE NOT EXISTS (SELECT 1 FROM sum_b y WHERE y.projet = x.projet AND y.communes = x.communes AND y.area_ha + y.length_km IS NOT NULL)""",
    "diff_fingerprints": f"""WITH {A}, {B}, n AS (SELECT md5, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb
  FROM (SELECT md5, 'a' AS side FROM a UNION ALL SELECT md5, 'b' FROM b) GROUP BY md5) SELECT md5, na AS a_nbre, nullif(nb, 0) AS b_nbre FROM n WHERE na > 0 AND na <> nb""",
    "drill_fingerprint": f"""WITH {A}, {B} SELECT num, projet, si_metier, numero_dossier, md5 FROM
 (SELECT *, count(*) OVER (PARTITION BY md5) AS na FROM a) x WHERE na <> (SELECT count(*) FROM b WHERE b.md5 = x.md5)""",
    "reconcile": f"""WITH {PROJECTS}, j AS (SELECT coalesce(x.projet, y.projet) AS projet, x.projet IS NULL AS no_a, y.projet IS NULL AS no_b,
  x.area_ha AS xa, y.area_ha AS ya, x.length_km AS xl, y.length_km AS yl FROM sum_a x FULL JOIN sum_b y ON x.projet = y.projet)
 SELECT projet, round(xa, 6) AS a_area_ha, round(ya, 6) AS b_area_ha, round(xl, 6) AS a_length_km, round(yl, 6) AS b_length_km,
 CASE WHEN no_b THEN 'only_a' WHEN no_a THEN 'only_b' WHEN {_far('xa', 'ya')} THEN 'changed_area' WHEN {_far('xl', 'yl')} THEN 'changed_length' ELSE 'same' END AS status FROM j""",
    "same_geometry_pairs": f"""WITH {FC}, i AS (SELECT DISTINCT projet, mo, communes, procedure, type, geometry FROM fc WHERE geometry IS NOT NULL),
 k AS (SELECT *, row_number() OVER () AS id FROM i) SELECT x.projet, count(*) AS n_others FROM k x JOIN k y ON x.geometry = y.geometry AND x.id <> y.id GROUP BY x.id, x.projet""",
    "fd_conflict_pairs": f"WITH {FC} " + _conflicts("duree", label=", 'duree' AS attribute") + " UNION ALL " + _conflicts("si_metier", label=", 'si_metier' AS attribute"),
    "fd_conflict_pairs_same_si": f"WITH {FCN} " + _conflicts("numero_dossier", (*_KEY, "si_metier")),
    "bbox_overlap_join": f"WITH {BOXED} SELECT {_A_SIDES}, {_B_SIDES}, ba.n AS a_n, bb.n AS b_n, {_COMMON} AS overlap_m2 FROM ba JOIN bb ON {_MEET}",
    "bbox_overlap_area": f"WITH {BOXED} SELECT {_A_SIDES}, ba.n AS a_n, sum(bb.n)::BIGINT AS n_meeting, sum(bb.n * {_COMMON}) AS overlap_m2 FROM ba JOIN bb ON {_MEET} GROUP BY ALL",
    "extract_with_footprint": f"""WITH {FLAT}, shape AS (SELECT mesure_id, kind <> 0 AS square, x, y FROM d_emprises_mesures JOIN d_emprises ON d_emprises.id = emprise_id),
 one AS (SELECT DISTINCT {_ATTRIBUTES}, square, x, y, commune FROM flat JOIN shape USING (mesure_id) JOIN town USING (mesure_id) WHERE has_topic),
 many AS (SELECT {_ATTRIBUTES}, square, x::DOUBLE AS x, y::DOUBLE AS y, {_repeated('commune')} AS communes FROM one GROUP BY {_ATTRIBUTES}, square, one.x, one.y)
 SELECT {_ATTRIBUTES}, communes, CASE WHEN square THEN 'Polygon' ELSE 'Point' END AS shape, CASE WHEN square THEN 5 ELSE 1 END::BIGINT AS n_positions,
 round(lon, 7) AS lon, round(lat, 7) AS lat FROM {lambert_inverse('many', 'x', 'y', 'lon', 'lat')}""",
    "extract_by_commune": f"""WITH {FLAT}, n AS (SELECT {_ATTRIBUTES}, cx, cy, commune, count(*) AS c FROM flat JOIN town USING (mesure_id)
  WHERE mesure_id NOT IN (SELECT mesure_id FROM d_emprises_mesures) GROUP BY ALL)
 SELECT {_ATTRIBUTES}, cx, cy, sum(c)::BIGINT AS n_communes, string_agg(coalesce(commune, 'NULL') || '*' || c, ',' ORDER BY commune NULLS LAST) AS communes FROM n GROUP BY {_ATTRIBUTES}, cx, cy""",
    "measures_in_footprints": f"WITH {BIZ}, {_COMPENSATION} SELECT id, procedure_id FROM comp WHERE drawn",
    "measures_not_in_footprints": f"WITH {BIZ}, {_COMPENSATION} SELECT id, procedure_id FROM comp WHERE NOT drawn",
    "delivery_stats": f"WITH {D} SELECT source, delivery_date, georef, count(*) AS nbre, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM d GROUP BY ALL",
    "point_census": f"WITH {D} SELECT source, delivery_date, georef, coalesce(sum(n_points), 0)::BIGINT AS nb_points FROM d GROUP BY ALL",
    "collection_signatures": f"WITH {D} SELECT source, delivery_date, georef, signature, count(*) AS nbre FROM d WHERE signature IS NOT NULL GROUP BY ALL",
    "collection_pivot": f"""WITH {D} SELECT source, delivery_date, count(*) AS nb_collections, nullif(count_if(signature = 'LineStringPointPolygon')::BIGINT, 0) AS pls, nullif(count_if(signature = 'LineStringPolygon')::BIGINT, 0) AS ls,
 nullif(count_if(signature = 'PointPolygon')::BIGINT, 0) AS ps, nullif(count_if(signature = 'LineStringPoint')::BIGINT, 0) AS pl FROM d WHERE signature IS NOT NULL AND georef = 'direct' GROUP BY ALL""",
    "stats_pivot": f"""WITH {D} SELECT source, delivery_date, count_if(georef = 'direct')::BIGINT AS nbre_direct, round(sum(area_m2) FILTER (georef = 'direct') / 10000) AS area_ha,
 round(sum(length_m) FILTER (georef = 'direct') / 1000) AS length_km, coalesce(sum(n_points) FILTER (georef = 'direct'), 0)::BIGINT AS nb_points,
 count_if(georef = 'commune')::BIGINT AS nbre_commune, coalesce(sum(n_points) FILTER (georef = 'commune'), 0)::BIGINT AS nb_points_commune FROM d GROUP BY ALL""",
    "aggregate_by_project": f"WITH {A} SELECT projet, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM a GROUP BY ALL",
    "aggregate_by_project_communes": f"WITH {TOWNS} SELECT projet, communes, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM ta GROUP BY ALL",
    "total_measures": f"WITH {A} SELECT round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM a",
    "listing_totals": f"WITH {B} SELECT count(*) AS nbre, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM b",
    "fingerprint_counts": f"WITH {A} SELECT md5, count(*) AS nbre FROM a GROUP BY md5",
    "distinct_geometries": f"""WITH {FA}, {FC}, s AS (SELECT DISTINCT geometry, area_m2, length_m FROM fa WHERE geometry IS NOT NULL)
 SELECT count(*) AS shapes, (SELECT count(*) FROM fc) AS rows, round(sum(area_m2) / 10000, 6) AS area_ha, round(sum(length_m) / 1000, 6) AS length_km FROM s""",
    "distinct_measures": f"""WITH {FA}, {FC}, s AS (SELECT geometry, any_value(area_m2) AS area_m2 FROM fa GROUP BY geometry), k AS (SELECT DISTINCT {', '.join(_KEY)} FROM fc)
 SELECT k.projet, count(*) AS measures, sum(area_m2) AS area_m2 FROM k LEFT JOIN s ON k.geometry = s.geometry GROUP BY k.projet""",
    "check_dependencies": f"WITH {FC} {_dependencies()}",
    "max_area_measures": f"WITH {A} SELECT num, projet, area_m2 FROM a WHERE area_m2 = (SELECT max(area_m2) FROM a)",
    "array_agg_distinct": f"""WITH {_PROJECT_TOWNS} SELECT projet_id, {_repeated('nom')} AS communes FROM (SELECT DISTINCT projet_id, nom FROM pt) GROUP BY projet_id""",
    "array_agg_all": f"""WITH {_PROJECT_TOWNS}, n AS (SELECT projet_id, nom, count(*) AS c FROM pt GROUP BY ALL)
 SELECT projet_id, sum(c)::BIGINT AS n, string_agg(coalesce(nom, 'NULL') || '*' || c, ',' ORDER BY nom NULLS LAST) AS communes FROM n GROUP BY projet_id""",
    "measures_per_year": f"WITH {BIZ}{_YEARS}",
    "kpi_summary": f"""WITH {BIZ}, {_COMPENSATION}, n AS (SELECT count(*) FILTER (drawn) AS with_shape,
  count(*) FILTER (NOT drawn AND id IN (SELECT mesure_id FROM d_communes_mesures)) AS town_only, count(duree_prescrite_realisation) AS timed FROM comp WHERE {_IS_C})
 SELECT unnest(['Mesures ayant a minima une emprise', 'Mesures géolocalisées uniquement à la commune', 'Mesures dont la durée est renseignée', 'Projets ']) AS libelle,
 unnest([with_shape, town_only, timed, (SELECT count(*) FROM d_projets)]) AS total FROM n""",
    "level_histogram": f"""WITH {BIZ}, {_COMPENSATION} SELECT {_LEVEL} AS code, n AS nb_mesures FROM
 (SELECT any_value(code) AS code, count(*) AS n FROM comp WHERE {_IS_C} GROUP BY length(code))""",
    "rank_by_area": f"WITH {A} SELECT num, projet, round(area_m2 / 10000, 6) AS area_ha FROM a ORDER BY area_ha DESC NULLS FIRST",
    "limit_features": f"""WITH {A}, s AS (SELECT num, projet, n_positions, sum(n_positions) OVER (ORDER BY area_m2 DESC, num, md5, geom_type, n_positions ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM a WHERE geometry IS NOT NULL)
 SELECT num, projet, n_positions FROM s WHERE coalesce(b, 0) < 2000""",
    "union_reports": f"WITH {A}, {B} " + " UNION ".join(f"SELECT {c} AS libelle, count(DISTINCT projet) AS total FROM {t} GROUP BY 1" for t in "ab" for c in ("type", "classe", "cat")),
    "generalise_gate": f"WITH {GATED} SELECT num, zoom, geom_type, n_positions, display FROM z",
    "generalise_single": f"WITH {GATED} SELECT num, zoom, geom_type, {_ROUNDED_SIDES} FROM z WHERE display = 'box'",
    "cluster_elements": f"WITH {CLUSTERS} SELECT num, zoom, geom_type, first, {_ROUNDED_SIDES} FROM ({_unfold('c', 'g')})",
    "merge_overlaps": f"WITH {WIDENED} SELECT num, zoom, geom_type, first, {_ROUNDED_SIDES} FROM ({_unfold('mw', 'q')})",
    "keep_identical_multipoint": f"""WITH {gated(WIDE, ZOOMS, "geom_type = 'MultiPoint'")} SELECT z.num, z.zoom, 'circle/0000FF' AS symbol FROM z
 JOIN eb a ON a.rid = z.rid AND a.el = 0 JOIN eb b ON b.rid = z.rid AND b.el = 1 JOIN eb c ON c.rid = z.rid AND c.el = 2
 WHERE z.geom_type = 'MultiPoint' AND display = 'fragments' AND least({_FAR_APART}) >= z.reach""",
    "emit_fragments": f"WITH {emitted(GATED)} SELECT num, zoom, geom_type, agg, shape, {_ROUNDED_SIDES} FROM shown",
    "marker_style": f"""WITH {emitted(gated(BOTH_PLACED, (-1, 8), 'geometry IS NOT NULL'))}
 SELECT source, 'direct' AS georef, zoom, shown.geom_type, shape, {_SYMBOL.replace('geom_type', 'shown.geom_type')} AS symbol, count(*) AS n FROM shown JOIN r USING (rid) GROUP BY ALL
 UNION ALL SELECT source, 'commune', zoom, 'Point', 'unchanged', 'diam/0000FF', count(*) FROM (SELECT '{FIRST}' AS source, geometry FROM ({st.plain(st.by_commune())})
  UNION ALL SELECT '{SECOND}', geometry FROM ({st.plain(st.by_commune(dropped=True))})) CROSS JOIN (SELECT unnest([-1, 8])::INTEGER AS zoom) WHERE geometry IS NOT NULL GROUP BY ALL""",
    "export_map_features": f"""WITH {emitted(gated(PLACED, (8,), f'xmin <= {_XMAX} AND xmax >= {_XMIN} AND ymin <= {_YMAX} AND ymax >= {_YMIN}'))}
 SELECT shown.num, projet, 'agg_' || agg AS agg, {_SYMBOL.replace('geom_type', 'shown.geom_type')} AS symbol,
 CASE shape WHEN 'unchanged' THEN shown.geom_type WHEN 'point' THEN 'Point' ELSE 'Polygon' END AS shown_type FROM shown JOIN r USING (rid)""",
    "export_dissolved": f"""WITH {A}, s AS (SELECT num, n_positions, CASE WHEN l_linenumber <> 7 THEN 1 WHEN l_suppkey % 2 = 0 THEN 3 ELSE 2 END AS members FROM a WHERE geometry IS NOT NULL),
 b AS (SELECT *, coalesce(sum(members) OVER (ORDER BY num ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
 SELECT num, n_positions AS nbre_of_pos, unnest(range(members)) AS member FROM b WHERE before < {EXPORT_LIMIT}""",
    "export_measure": f"""WITH {A}, s AS (SELECT *, row_number() OVER (ORDER BY num) AS k FROM a WHERE geometry IS NOT NULL)
 SELECT num, projet, geom_type AS shape, n_positions AS nbre_of_pos FROM s WHERE num = (SELECT max(num) FROM a WHERE geometry IS NOT NULL)""",
    "geodesic_measures": GEODESIC,
    "validate_schema": f"WITH {_FV} " + " UNION ALL ".join(
        [_rule(f"required:{c}", "false") for c in ("mesure_id", "projet", "categorie", "communes", "procedure", "classe")]
        + [
            _rule("required:mo", "l_partkey % 47 = 0"),
            _rule("pattern:date_decision", "date_decision IS NOT NULL AND l_partkey % 43 = 0"),
            _rule("const:classe", "l_partkey % 41 = 0"),
            _rule("type:geometry", "false"),
            _rule("coordinates:geometry", f"{_FLAT} OR {_DOT}"),
        ]
    ),
    "compare_attribute_syntax": f"WITH {FA}, {FB} {_attributes()}",
}
