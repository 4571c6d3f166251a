"""Deliveries and business tables derived from the order/line tables, as SQL text.

The same text runs in Spark and in the SQL engine the results are checked with, so both
start from equal rows. Table names are written ``@lineitem`` and replaced by view names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


_registered: dict[str, str] = {}


def read_tables(spark: SparkSession, sf_dir: str) -> None:
    """Views ``tm_*`` over the tables of ``sf_dir``; made anew only when the folder changes."""
    session = spark.sparkContext.applicationId
    if _registered.get(session) == sf_dir and spark.catalog.tableExists("tm_lineitem"):
        return
    _registered[session] = sf_dir
    for name in SOURCE_TABLES:
        table = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        if name == "lineitem":
            # what is made of a line item costs far more than the item: a file of one row group is still worked on by all cores.
            # Every text joins or groups by the order, so this is the shuffle that it needs anyway
            table = table.repartition("l_orderkey")
        table.createOrReplaceTempView(f"tm_{name}")


def sample(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Run one of the texts below over the tables of ``sf_dir``."""
    read_tables(spark, sf_dir)
    return spark.sql(sql.replace("@", "tm_"))


def plain(sql: str) -> str:
    """The text with plain table names."""
    return sql.replace("@", "")


def _pos(x: str, y: str) -> str:
    return f"'[',{x},',',{y},']'"


def _list(*items: str) -> str:
    return "'['," + ",',',".join(items) + ",']'"


def _geojson(kind: str, coordinates: str) -> str:
    return f"concat('{{\"type\":\"{kind}\",\"coordinates\":',{coordinates},'}}')"


_SW, _SE, _NE, _NW = _pos("x", "y"), _pos("x2", "y"), _pos("x2", "y2"), _pos("x", "y2")
_RECT = _list(_SW, _SE, _NE, _NW, _SW)
_TRIANGLE = _list(_SW, _SE, _NE, _SW)
_FAR_TRIANGLE = _list(_pos("x3", "y"), _pos("x4", "y"), _pos("x4", "y2"), _pos("x3", "y"))

_SHAPES = {
    "1": _geojson("Point", _SW),
    "2": _geojson("MultiPoint", _list(_SW, _SE, _NE)),
    "3": _geojson("LineString", _list(_SW, _SE, _NE)),
    "4": _geojson("MultiLineString", _list(_list(_SW, _SE), _list(_NW, _NE))),
    "5": _geojson("Polygon", _list(_RECT)),
    "6": _geojson("MultiPolygon", _list(_list(_TRIANGLE), _list(_FAR_TRIANGLE))),
}

_COLLECTION = (
    "concat('{\"type\":\"GeometryCollection\",\"geometries\":[',"
    + _geojson("Point", _SW)
    + ",',',"
    + _geojson("LineString", _list(_SW, _NE))
    + ",CASE WHEN l_suppkey % 2 = 0 THEN concat(',',"
    + _geojson("Polygon", _list(_TRIANGLE))
    + ") ELSE '' END,']}')"
)

_SHAPE_CASES = (
    "\n".join(f" WHEN l_linenumber = {k} THEN {v}" for k, v in _SHAPES.items())
    + f"\n ELSE {_COLLECTION}"
)

GEOMETRY = f"CASE WHEN l_partkey % 53 = 0 THEN NULL\n{_SHAPE_CASES}\nEND"

# Polygons and lines broken on purpose, for the validity audit; the last polygons cross each other or have a hole far off.
BROKEN_GEOMETRY = (
    "CASE WHEN l_partkey % 53 = 0 THEN NULL\n"
    f" WHEN l_linenumber = 5 AND l_partkey % 13 = 0 THEN {_geojson('Polygon', _list(_list(_SW, _NE, _SE, _NW, _SW)))}\n"
    f" WHEN l_linenumber = 5 AND l_partkey % 17 = 0 THEN {_geojson('Polygon', _list(_list(_SW, _SE, _NE, _NW)))}\n"
    f" WHEN l_linenumber = 5 AND l_partkey % 19 = 0 THEN {_geojson('Polygon', _list(_list(_SW, _SE, _SE, _NE, _NW, _SW)))}\n"
    f" WHEN l_linenumber = 5 AND l_partkey % 23 = 0 THEN {_geojson('Polygon', _list(_list(_SW, _NW, _NE, _SE, _SW)))}\n"
    f" WHEN l_linenumber = 5 AND l_partkey % 29 = 0 THEN {_geojson('Polygon', _list(_list(_SW, _SE, _SW)))}\n"
    f" WHEN l_linenumber = 6 AND l_partkey % 13 = 0 THEN {_geojson('MultiPolygon', _list(_list(_TRIANGLE), _list(_list(_NW, _SE, _NE, _NW))))}\n"
    f" WHEN l_linenumber = 6 AND l_partkey % 17 = 0 THEN {_geojson('MultiPolygon', _list(_list(_TRIANGLE, _FAR_TRIANGLE)))}\n"
    f" WHEN l_linenumber = 3 AND l_partkey % 13 = 0 THEN {_geojson('LineString', _list(_SW))}\n"
    f" WHEN l_linenumber = 3 AND l_partkey % 17 = 0 THEN {_geojson('LineString', _list(_SW, _SE, _SE))}\n"
    f"{_SHAPE_CASES}\nEND"
)


def base(scale: str = "40", where: str = "", y: str | None = None, height: str = "20") -> str:
    """Line items with a place (x, y) and an extent (w, h), all whole metres."""
    yi = y or "CASE WHEN s_nationkey = 24 THEN 7640000 ELSE 6500000 END + (l_suppkey % 100) * 1000"
    return f"""SELECT *, cast(xi as string) AS x, cast(yi as string) AS y, cast(xi+w as string) AS x2,
 cast(yi+h as string) AS y2, cast(xi+50000 as string) AS x3, cast(xi+50000+w as string) AS x4,
 cast(l_partkey as string) AS k FROM (
 SELECT l.*, o_orderdate, o_orderpriority, p_type, p_brand, s_name, n_name, s_nationkey,
  CASE WHEN s_nationkey = 24 THEN 330000 ELSE 400000 END + (l_partkey % 400) * 100 AS xi,
  {yi} AS yi,
  cast(l_quantity as int) * {scale} AS w, cast(l_quantity as int) * {height} AS h
 FROM @lineitem l JOIN @orders ON l_orderkey = o_orderkey JOIN @part ON l_partkey = p_partkey
  JOIN @supplier ON l_suppkey = s_suppkey JOIN @nation ON s_nationkey = n_nationkey {where})"""


_COMMON = """l_orderkey * 8 + l_linenumber AS mesure_id,
 concat('P', cast(l_orderkey % 400 as string)) AS projet, p_type AS categorie, s_name AS mo"""

_DATED = """o_orderpriority AS procedure,
 CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE cast(o_orderdate as date) END AS date_decision,
 'Compensation' AS classe"""

_LASTING = """l_linestatus AS cat, p_brand AS sscat,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE concat(cast(cast(l_quantity as int) as string), ' an(s)') END AS duree"""


def first_publisher(
    geometry: str = GEOMETRY, extra: str = "", y: str | None = None, scale: str = "40", height: str = "20"
) -> str:
    """Array literals, two entries per measure, raw projection."""
    return f"""SELECT {_COMMON},
 CASE WHEN l_suppkey % 11 = 0 THEN '{{NULL}}' WHEN l_suppkey % 5 = 0 THEN concat('{{"', n_name, ' A","', n_name, ' B"}}') ELSE concat('{{', n_name, '}}') END AS communes,
 {_DATED}, l_returnflag AS type, {_LASTING},
 CASE WHEN l_suppkey % 3 = 0 THEN '{{ONAGRE,ONAGRE}}' WHEN l_suppkey % 3 = 1 THEN '{{S3IC,ONAGRE}}' ELSE NULL END AS si_metier,
 CASE WHEN l_suppkey % 3 = 0 THEN concat('{{', k, ',', k, '}}') WHEN l_suppkey % 3 = 1 THEN concat('{{', k, ',Z', k, '}}') ELSE NULL END AS numero_dossier,
 {geometry} AS geometry{extra} FROM ({base(scale, y=y, height=height)})"""


def second_publisher(geometry: str = GEOMETRY, extra: str = "", y: str | None = None) -> str:
    """Feed style: ``a+b`` arrays, ``type_mesure``, some projects and rows dropped, some shapes wider."""
    rows = base(
        "(CASE WHEN l_orderkey % 10 = 0 THEN 45 ELSE 40 END)",
        "WHERE l_orderkey % 400 NOT IN (7, 42) AND l_partkey % 97 <> 0",
        y,
    )
    return f"""SELECT {_COMMON},
 CASE WHEN l_suppkey % 11 = 0 THEN NULL WHEN l_suppkey % 5 = 0 THEN concat(n_name, ' A+', n_name, ' B') ELSE n_name END AS communes,
 {_DATED}, l_returnflag AS type_mesure, {_LASTING},
 CASE WHEN l_suppkey % 3 = 0 THEN 'ONAGRE' WHEN l_suppkey % 3 = 1 THEN 'ONAGRE+S3IC' ELSE NULL END AS si_metier,
 CASE WHEN l_suppkey % 3 = 0 THEN k WHEN l_suppkey % 3 = 1 THEN concat(k, '+Z', k) ELSE NULL END AS numero_dossier,
 {geometry} AS geometry{extra} FROM ({rows})"""


# Line numbers, extents and place next to the delivered columns: what checks compute from.
GENERATOR_COLUMNS = ", l_linenumber, l_partkey, l_suppkey, s_nationkey, xi, yi, w, h"

# Extents ten times as large, so that shapes are wider than some pixels at all zooms.
WIDE = {"scale": "400", "height": "200"}

# A territory that grows with the data: each order has a strip of its own, next strips overlap.
GROWING_TERRITORY = "6500000 + l_orderkey * 500"


def by_commune(dropped: bool = False) -> str:
    """Measures placed at a town centre only, one per order."""
    where = "WHERE o_orderkey % 400 NOT IN (7, 42)" if dropped else ""
    return f"""SELECT o_orderkey * 8 AS mesure_id, concat('P', cast(o_orderkey % 400 as string)) AS projet,
 c_mktsegment AS categorie, c_name AS mo, concat('{{', n_name, '}}') AS communes, o_orderpriority AS procedure,
 cast(o_orderdate as date) AS date_decision, 'Compensation' AS classe, o_orderstatus AS type, 'x' AS cat, 'y' AS sscat,
 cast(NULL as string) AS duree, cast(NULL as string) AS si_metier, cast(NULL as string) AS numero_dossier,
 CASE WHEN c_nationkey % 9 = 0 THEN NULL
  ELSE concat('{{"type":"Point","coordinates":[', cast(400000 + c_nationkey * 10000 as string), ',', cast(6500000 + c_nationkey * 5000 as string), ']}}') END AS geometry
FROM @orders JOIN @customer ON o_custkey = c_custkey JOIN @nation ON c_nationkey = n_nationkey {where}"""


def audited(dossiers: bool = False) -> str:
    """Repeated measures with conflicting attributes and shapes shared between projects."""
    names = {
        "projet": "projet",
        "mo": "mo",
        "communes": "communes",
        "procedure": "procedure",
        "type": "type",
        "geometry": "geometry",
        "categorie": "categorie",
        "date_decision": "date_decision",
        "classe": "classe",
        "cat": "cat",
        "sscat": "sscat",
        "duree": "duree",
        "si_metier": "si_metier",
        "numero_dossier": "numero_dossier",
    }

    def pick(where: str = "", **changed: str) -> str:
        cols = ", ".join(f"{v} AS {k}" for k, v in {**names, **changed}.items())
        return f"SELECT {cols} FROM fa {where}"

    parts = [
        pick(),
        pick("WHERE mesure_id % 29 = 0", duree="'1 an(s)'"),
        pick("WHERE mesure_id % 31 = 0", si_metier="'{CASCADE}'"),
        pick("WHERE mesure_id % 17 = 0", projet="concat(projet, 'X')"),
    ]
    if dossiers:
        parts.append(
            pick("WHERE mesure_id % 23 = 0", numero_dossier="concat('{N', cast(mesure_id % 7 as string), '}')")
        )
    return f"WITH fa AS ({first_publisher()}) " + " UNION ALL ".join(parts)


# ---- normalised business tables ---------------------------------------------------------

BUSINESS = {
    "d_mesures": """SELECT l_orderkey * 8 + l_linenumber AS id, l_orderkey AS procedure_id, l_linenumber AS mesure_categorie_id,
 CASE WHEN min(l_partkey) % 4 = 0 THEN NULL ELSE min(l_quantity) / 2 END AS duree_prescrite_realisation,
 min(l_suppkey) % 3 AS duree_unite_id FROM @lineitem GROUP BY l_orderkey, l_linenumber""",
    "d_procedures": """SELECT o_orderkey AS id, o_custkey AS projet_id,
 CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE cast(o_orderdate AS date) END AS date_decision,
 o_orderkey % 6 AS procedure_type_id FROM @orders""",
    "d_projets": """SELECT c_custkey AS id, c_name AS nom, c_nationkey % 6 AS projet_categorie_id,
 CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_custkey % 20 END AS maitrise_ouvrage_adresse_id FROM @customer""",
    "d_communes": """SELECT n_nationkey AS id, CASE WHEN n_nationkey % 9 = 0 THEN NULL ELSE n_name END AS nom,
 400000 + n_nationkey * 10000 AS cx, 6500000 + n_nationkey * 5000 AS cy FROM @nation""",
    "d_communes_mesures": """SELECT DISTINCT l_orderkey * 8 + l_linenumber AS mesure_id, s_nationkey AS commune_id
 FROM @lineitem JOIN @supplier ON l_suppkey = s_suppkey WHERE l_partkey % 10 <> 0
UNION SELECT l_orderkey * 8 + l_linenumber, (s_nationkey + 1) % 25
 FROM @lineitem JOIN @supplier ON l_suppkey = s_suppkey WHERE l_partkey % 10 IN (2, 4)""",
    "d_emprises_mesures": """SELECT DISTINCT l_orderkey * 8 + l_linenumber AS mesure_id, l_partkey AS emprise_id
 FROM @lineitem WHERE l_linenumber <= 4 AND l_partkey % 3 <> 0""",
    # Two footprints in every seven repeat a shape that another one has.
    # Points, squares, and squares whose ring isn't closed.
    "d_emprises": """SELECT id, srid, kind, x, y, CASE WHEN kind = 0 THEN concat('{"type":"Point","coordinates":[', x, ',', y, ']}')
  ELSE concat('{"type":"Polygon","coordinates":[[[', x, ',', y, '],[', x + 40, ',', y, '],[', x + 40, ',', y + 40, '],[', x, ',', y + 40, ']', CASE WHEN kind = 1 THEN concat(',[', x, ',', y, ']') ELSE '' END, ']]}') END AS geometry
 FROM (SELECT p_partkey AS id, CASE WHEN p_partkey % 19 = 0 THEN 32740 ELSE 2154 END AS srid, CASE WHEN p_partkey % 5 <> 0 THEN 0 WHEN p_partkey % 25 = 0 THEN 2 ELSE 1 END AS kind,
  400000 + (p_partkey - p_partkey % 7 % 3) * 10 AS x, 6500000 + p_size * 100 AS y FROM @part)""",
    "d_mesure_categories": "SELECT * FROM (VALUES (1, 'C'), (2, 'C1'), (3, 'C1.a'), (4, 'C2'), (5, 'R1'), (6, 'C2.b.1'), (7, 'A')) AS t(id, code)",
    "d_classification": """SELECT * FROM (VALUES (1, 'Compensation', 'T1', 'K1', 'S1'), (2, 'Compensation', 'T1', 'K2', 'S2'),
 (3, 'Compensation', 'T2', 'K1', 'S3'), (4, 'Compensation', 'T2', 'K2', 'S4'), (5, 'Reduction', 'T3', 'K3', 'S5'),
 (6, 'Compensation', 'T3', 'K3', 'S6'), (7, 'Accompagnement', 'T4', 'K4', 'S7')) AS t(id, classe, type, cat, sscat)""",
    "d_unites": "SELECT * FROM (VALUES (0, 'Mois'), (1, 'Année')) AS t(id, nom)",
    "d_projet_categories": "SELECT * FROM (VALUES (0), (1), (2), (3), (4)) AS t(id)",
    "d_eurovoc": "SELECT * FROM (VALUES (0, 'TRANSPORTS'), (1, 'ENERGIE'), (2, 'ENVIRONNEMENT'), (3, 'URBANISME'), (4, 'AGRICULTURE')) AS t(id, libelle)",
    "d_adresses": "SELECT c_custkey AS id, c_custkey % 7 AS maitrise_ouvrage_id FROM @customer WHERE c_custkey < 18",
    "d_ouvrages": "SELECT n_nationkey AS id, concat('MO ', n_name) AS nom FROM @nation WHERE n_nationkey < 6",
    "d_procedure_types": "SELECT * FROM (VALUES (0, 'Defrichement'), (1, 'Especes'), (2, 'Eau'), (3, 'ICPE'), (4, 'DUP')) AS t(id, nom)",
    "d_procedure_references": """SELECT o_orderkey AS procedure_id, o_orderkey % 4 AS reference_type_id, concat('N', cast(o_orderkey as string)) AS numero_dossier
 FROM @orders WHERE o_orderkey % 3 <> 0
UNION ALL SELECT o_orderkey, 1, concat('M', cast(o_orderkey as string)) FROM @orders WHERE o_orderkey % 15 = 1""",
    "d_reference_types": "SELECT * FROM (VALUES (0, 'ONAGRE'), (1, 'CASCADE'), (2, 'S3IC')) AS t(id, nom)",
}


class _Business(dict):
    """Business tables, each built when it is first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        super().__init__()
        self._from = (spark, sf_dir)

    def __missing__(self, name: str) -> DataFrame:
        self[name] = sample(*self._from, BUSINESS[name])
        return self[name]


def business(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return _Business(spark, sf_dir)


def business_with() -> str:
    """The business tables as common table expressions."""
    return ",\n".join(f"{name} AS ({plain(sql)})" for name, sql in BUSINESS.items())
