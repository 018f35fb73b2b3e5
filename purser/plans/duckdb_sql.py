"""Independent SQL for every registered query that SQL can express (DuckDB dialect)."""

from __future__ import annotations

SPEND = ("RoomService", "FoodCourt", "ShoppingMall", "Spa", "VRDeck")
SCALED = (*SPEND, "TotalExpenses")

_MANIFEST = """
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS member
  FROM lineitem),
m AS (
  SELECT printf('%07d_%02d', l_orderkey, member) AS PassengerId,
    CASE WHEN l_partkey % 11 <> 0 THEN
      CASE o_custkey % 3 WHEN 0 THEN 'Earth' WHEN 1 THEN 'Europa' WHEN 2 THEN 'Mars' END END AS HomePlanet,
    CASE WHEN l_partkey % 23 <> 0 THEN l_discount <= 0.02 END AS CryoSleep,
    CASE WHEN l_partkey % 13 <> 0 THEN substr('ABCDEFGT', CAST(l_suppkey % 8 + 1 AS INTEGER), 1) || '/'
      || l_suppkey || '/' || CASE WHEN l_orderkey % 2 = 0 THEN 'P' ELSE 'S' END END AS Cabin,
    CASE WHEN l_partkey % 17 <> 0 THEN
      CASE l_returnflag WHEN 'A' THEN 'TRAPPIST-1e' WHEN 'N' THEN 'DEST-N' WHEN 'R' THEN 'DEST-R' END
      END AS Destination,
    CASE WHEN l_partkey % 7 <> 0 THEN CAST(p_size AS DOUBLE) END AS Age,
    CASE WHEN l_partkey % 19 <> 0 THEN l_tax = 0 END AS VIP,
    CASE WHEN l_partkey % 29 <> 0 THEN CASE WHEN l_discount <= 0.02 THEN 0 ELSE l_quantity END END AS RoomService,
    CASE WHEN l_partkey % 31 <> 0 THEN
      CASE WHEN l_discount <= 0.02 THEN 0 ELSE CAST(l_partkey % 500 AS DOUBLE) END END AS FoodCourt,
    CASE WHEN l_partkey % 37 <> 0 THEN
      CASE WHEN l_discount <= 0.02 THEN 0 ELSE CAST(l_suppkey AS DOUBLE) END END AS ShoppingMall,
    CASE WHEN l_partkey % 41 <> 0 THEN
      CASE WHEN l_discount <= 0.02 THEN 0 ELSE CAST(floor(l_extendedprice / 100) AS DOUBLE) END END AS Spa,
    CASE WHEN l_partkey % 43 <> 0 THEN
      CASE WHEN l_discount <= 0.02 THEN 0 ELSE CAST(l_orderkey % 97 AS DOUBLE) END END AS VRDeck,
    CASE WHEN l_partkey % 47 <> 0 THEN c_name END AS Name,
    l_linestatus = 'F' AS Transported,
    l_orderkey % 5 = 0 AS scoring
  FROM numbered
  LEFT JOIN orders ON o_orderkey = l_orderkey
  LEFT JOIN part ON p_partkey = l_partkey
  LEFT JOIN customer ON c_custkey = o_custkey),
d AS (
  SELECT *, split_part(PassengerId, '_', 1) AS GroupNumber, split_part(PassengerId, '_', 2) AS InGroupNumber,
    split_part(Cabin, '/', 1) AS Deck, split_part(Cabin, '/', 2) AS Num, split_part(Cabin, '/', 3) AS Side,
    HomePlanet || ' to ' || Destination AS JourneyRoute,
    RoomService + FoodCourt + ShoppingMall + Spa + VRDeck AS TotalExpenses,
    CASE WHEN VIP THEN 'VIP' ELSE 'Not-VIP' END AS VIP_label,
    CASE WHEN Transported THEN 'Transported' ELSE 'Not-Transported' END AS Transported_label,
    CASE WHEN CryoSleep THEN 'Cryo Sleeping' ELSE 'Not-Cryo Sleeping' END AS CryoSleep_label
  FROM m)"""


def _sql(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join((_MANIFEST, *ctes)) + "\n" + body


def _each(template: str, cols=SPEND, sep: str = ", ") -> str:
    return sep.join(template.format(c=c) for c in cols)


_PLANET_FROM_DECK = """CASE WHEN Deck IN ('A', 'B', 'C', 'T') THEN 'Europa' WHEN Deck IN ('E', 'F', 'G') THEN 'Earth'
  WHEN Deck = 'D' THEN 'Mars' END"""
_DECK_FROM_PLANET = "CASE {p} WHEN 'Earth' THEN 'G' WHEN 'Europa' THEN 'B' WHEN 'Mars' THEN 'F' END"
_SIZE = "CAST(max(CAST(InGroupNumber AS INTEGER)) AS INTEGER)"
_SINGLE = "CASE WHEN max(InGroupNumber) = '01' THEN 'Single' ELSE 'Not-Single' END"


def _last_first_seen(name: str, source: str, col: str) -> str:
    return f"""{name} AS (
  SELECT GroupNumber, arg_max({col}, f) AS {col} FROM (
    SELECT GroupNumber, {col}, min(CAST(split_part(PassengerId, '_', 2) AS BIGINT)) AS f FROM {source} WHERE {col} IS NOT NULL GROUP BY ALL)
  GROUP BY GroupNumber)"""


def _single_valued(name: str, source: str) -> str:
    return f"""{name} AS (
  SELECT GroupNumber, min(Destination) AS Destination FROM {source} WHERE Destination IS NOT NULL
  GROUP BY GroupNumber HAVING count(DISTINCT Destination) = 1)"""


def _spend_means(source: str, zero_is_missing: bool = True, ceil: bool = True) -> str:
    mean = "avg({c})"
    mean = f"nullif({mean}, 0)" if zero_is_missing else mean
    mean = f"ceil({mean})" if ceil else mean
    return f"""means AS (
  SELECT JourneyRoute, VIP, {_each(mean + " AS {c}")} FROM {source}
  WHERE JourneyRoute IS NOT NULL AND VIP IS NOT NULL GROUP BY JourneyRoute, VIP)"""


_TOTAL = "RoomService + FoodCourt + ShoppingMall + Spa + VRDeck"

_CLEAN_TRAIN = (
    """c1 AS (SELECT PassengerId, HomePlanet, CryoSleep, Destination, Age, VIP, RoomService, FoodCourt, ShoppingMall, Spa,
    VRDeck, coalesce(Name, 'Unknown') AS Name, Transported, Deck, Num, Side, GroupNumber
  FROM d WHERE HomePlanet IS NOT NULL OR Cabin IS NOT NULL)""",
    _last_first_seen("planets", "c1", "HomePlanet"),
    _last_first_seen("sides", "c1", "Side"),
    f"""c2 AS (SELECT c1.* REPLACE (coalesce(planets.HomePlanet, {_PLANET_FROM_DECK}) AS HomePlanet, sides.Side AS Side)
  FROM c1 LEFT JOIN planets USING (GroupNumber) LEFT JOIN sides USING (GroupNumber))""",
    f"""c3 AS (SELECT * REPLACE (coalesce(Deck, {_DECK_FROM_PLANET.format(p='HomePlanet')}) AS Deck) FROM c2
  WHERE Side IS NOT NULL AND Num IS NOT NULL)""",
    _single_valued("ones", "c3"),
    """c4 AS (SELECT c3.* REPLACE (coalesce(c3.Destination, ones.Destination) AS Destination)
  FROM c3 LEFT JOIN ones USING (GroupNumber))""",
    "c5 AS (SELECT *, HomePlanet || ' to ' || Destination AS JourneyRoute FROM c4 WHERE Destination IS NOT NULL)",
    _spend_means("c5"),
    f"""c6 AS (SELECT c5.* REPLACE ({_each("coalesce(c5.{c}, means.{c}) AS {c}")})
  FROM c5 LEFT JOIN means USING (JourneyRoute, VIP))""",
    f"""c7 AS (SELECT * REPLACE ({_each("CASE WHEN (" + _TOTAL + ") IS NULL AND CryoSleep AND {c} IS NULL THEN 0 ELSE {c} END AS {c}")})
  FROM c6)""",
    f"c8 AS (SELECT *, {_TOTAL} AS TotalExpenses FROM c7 WHERE {_each('{c} IS NOT NULL', sep=' AND ')})",
    "ages AS (SELECT HomePlanet, avg(Age) AS Age FROM c8 WHERE HomePlanet IS NOT NULL GROUP BY HomePlanet)",
    """clean AS (SELECT c8.* REPLACE (CASE WHEN c8.HomePlanet IS NOT NULL THEN ceil(coalesce(c8.Age, ages.Age)) END AS Age)
  FROM c8 LEFT JOIN ages USING (HomePlanet) WHERE CryoSleep IS NOT NULL AND VIP IS NOT NULL)""",
)

# The steps that cleaning_profile counts, and the tables after them.
_STEPS = {
    "source": "d", "with a planet or a cabin": "c1", "planets and cabins filled": "c3", "destinations filled": "c5", "clean": "clean",
}

_CLEAN_TEST = (
    """t1 AS (SELECT PassengerId, HomePlanet, CryoSleep, Destination, Age, VIP, RoomService, FoodCourt, ShoppingMall, Spa,
    VRDeck, coalesce(Name, 'Unknown') AS Name, Deck, Side, GroupNumber FROM d)""",
    _last_first_seen("planets", "t1", "HomePlanet"),
    _last_first_seen("sides", "t1", "Side"),
    _single_valued("ones", "t1"),
    f"""t2 AS (SELECT t1.* REPLACE (coalesce(planets.HomePlanet, {_PLANET_FROM_DECK}, 'Europa') AS HomePlanet,
    coalesce(sides.Side, 'P') AS Side, coalesce(t1.Destination, ones.Destination) AS Destination)
  FROM t1 LEFT JOIN planets USING (GroupNumber) LEFT JOIN sides USING (GroupNumber) LEFT JOIN ones USING (GroupNumber))""",
    f"""t3 AS (SELECT * REPLACE (coalesce(Deck, {_DECK_FROM_PLANET.format(p='HomePlanet')}) AS Deck,
    CASE WHEN Destination IS NULL AND HomePlanet IN ('Earth', 'Europa', 'Mars') THEN 'TRAPPIST-1e' ELSE Destination END
      AS Destination) FROM t2)""",
    "t4 AS (SELECT *, HomePlanet || ' to ' || Destination AS JourneyRoute FROM t3)",
    "ages AS (SELECT HomePlanet, avg(Age) AS Age FROM t4 GROUP BY HomePlanet)",
    _spend_means("t4"),
    f"""t5 AS (SELECT t4.* REPLACE (ceil(coalesce(t4.Age, ages.Age)) AS Age, {_each("coalesce(t4.{c}, means.{c}) AS {c}")})
  FROM t4 LEFT JOIN ages USING (HomePlanet) LEFT JOIN means USING (JourneyRoute, VIP))""",
    f"""t6 AS (SELECT * REPLACE ({_each("CASE WHEN (" + _TOTAL + ") IS NULL AND CryoSleep AND {c} IS NULL THEN 0 ELSE {c} END AS {c}")})
  FROM t5)""",
    f"global AS (SELECT {_each('avg({c}) AS g_{c}')} FROM t6)",
    f"t7 AS (SELECT t6.* REPLACE ({_each('coalesce({c}, g_{c}) AS {c}')}) FROM t6 CROSS JOIN global)",
    f"""clean AS (SELECT * REPLACE (coalesce(CryoSleep, false) AS CryoSleep, coalesce(VIP, false) AS VIP),
    {_TOTAL} AS TotalExpenses FROM t7)""",
)

_GROUPS = f"groups AS (SELECT GroupNumber, {_SIZE} AS GroupSize, {_SINGLE} AS Is_Single FROM {{source}} GROUP BY GroupNumber)"
_SIZE_CLASS = """CASE WHEN GroupSize <= e0 + (e1 - e0) / 3 THEN 'Small' WHEN GroupSize <= e0 + 2 * (e1 - e0) / 3
  THEN 'Medium' ELSE 'Large' END"""
_AGE_EDGES = "age_edges AS (SELECT quantile_cont(Age, [0.2, 0.4, 0.6, 0.8]) AS q FROM {source})"
_AGE_CLASS = """CASE WHEN Age <= q[1] THEN 'A' WHEN Age <= q[2] THEN 'B' WHEN Age <= q[3] THEN 'C'
  WHEN Age <= q[4] THEN 'D' WHEN Age IS NOT NULL THEN 'E' END"""
_RATIO = "coalesce(CASE WHEN TotalExpenses <> 0 THEN {c} / TotalExpenses END, 0) AS Ratio{c}"

_WITH_RATIO = f"dr AS (SELECT *, {_RATIO.format(c='RoomService')} FROM d)"

_RULE = """scored AS (
  SELECT PassengerId, CAST(Transported AS INTEGER) AS label,
    CASE WHEN CryoSleep THEN 0.5 ELSE 0 END + CASE WHEN NOT VIP THEN 0.25 ELSE 0 END
      + CASE WHEN Age < 18 THEN 0.125 ELSE 0 END AS score,
    CASE WHEN ('0x' || substr(md5(PassengerId || '|13'), 1, 8))::BIGINT % 10000 < 1500 THEN 'val' ELSE 'train' END AS split,
    ('0x' || substr(md5(PassengerId || '|13'), 1, 8))::BIGINT % 5 AS fold
  FROM d),
ruled AS (SELECT *, CAST(score >= 0.5 AS INTEGER) AS prediction FROM scored)"""

_CORR = ("CryoSleep", "Age", "VIP", *SPEND, "Transported", "TotalExpenses")
_DECKS = ("A", "B", "C", "D", "E", "F", "G", "T")


def _crosstab(count: str) -> str:
    cells = ", ".join(f"count({count}) FILTER (Deck = '{k}') AS {k}" for k in _DECKS)
    return _sql(f"SELECT HomePlanet, {cells} FROM d WHERE HomePlanet IS NOT NULL AND Deck IS NOT NULL GROUP BY HomePlanet")


def _box(x: str, by: str) -> str:
    label = f"{by}_label"
    return f"""SELECT '{x}' AS measure, '{by}' AS "by", v AS value, n, round(q[1], 6) AS min_value, round(q[2], 6) AS q1_value,
  round(q[3], 6) AS median_value, round(q[4], 6) AS q3_value, round(q[5], 6) AS max_value,
  round(q[2] - 1.5 * (q[4] - q[2]), 6) AS lower_value, round(q[4] + 1.5 * (q[4] - q[2]), 6) AS upper_value,
  (SELECT count(*) FROM dr WHERE dr.{label} = v
     AND ({x} < q[2] - 1.5 * (q[4] - q[2]) OR {x} > q[4] + 1.5 * (q[4] - q[2]))) AS n_outliers
  FROM (SELECT {label} AS v, count({x}) AS n, quantile_cont({x}, [0, 0.25, 0.5, 0.75, 1]) AS q FROM dr GROUP BY {label})"""


def _corr_cell(a: str, b: str) -> str:
    value = "1.0" if a == b else f"round(corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)), 6)"
    return f"SELECT '{a}' AS col_a, '{b}' AS col_b, {value} AS corr FROM d"


def _dim_rows(cols: dict[str, str], keep: str, source: str = "d") -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS dim, CAST({expr} AS VARCHAR) AS value, {keep} FROM {source}"
                              for name, expr in cols.items())


def _one_hot(source: str, levels: dict[str, tuple[str, ...]]) -> str:
    flags = ", ".join(f"coalesce({c} = '{v}', false) AS \"{c}_{v}\"" for c, vs in levels.items() for v in vs)
    return f"SELECT PassengerId, VIP, {flags} FROM {source}"


_LEVELS = {
    "HomePlanet": ("Earth", "Europa", "Mars"),
    "Destination": ("DEST-N", "DEST-R", "TRAPPIST-1e"),
    "Deck": _DECKS,
    "Side": ("P", "S"),
}


def _report() -> str:
    cells = ", ".join(f"CAST(count(*) FILTER (label = {a} AND prediction = {b}) AS DOUBLE) AS c{a}{b}" for a in (0, 1) for b in (0, 1))
    per_class = " UNION ALL ".join(
        f"""SELECT {k} AS k, c{k}{k} AS hit, c{k}0 + c{k}1 AS support, c0{k} + c1{k} AS guessed,
  c00 + c11 AS right_rows, c00 + c01 + c10 + c11 AS total FROM cells""" for k in (0, 1))
    return _sql(
        """SELECT CASE k WHEN 0 THEN 'Not-Transferred' ELSE 'Transferred' END AS class, round(p, 6) AS precision,
  round(r, 6) AS recall, round(f, 6) AS f1, CAST(support AS BIGINT) AS support FROM scores
UNION ALL SELECT 'accuracy', NULL, NULL, round(any_value(right_rows / total), 6), CAST(any_value(total) AS BIGINT) FROM scores
UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), CAST(any_value(total) AS BIGINT) FROM scores
UNION ALL SELECT 'weighted avg', round(sum(p * support) / any_value(total), 6), round(sum(r * support) / any_value(total), 6),
  round(sum(f * support) / any_value(total), 6), CAST(any_value(total) AS BIGINT) FROM scores""",
        _RULE,
        f"cells AS (SELECT {cells} FROM ruled)",
        f"classes AS ({per_class})",
        """rates AS (SELECT *, CASE WHEN guessed > 0 THEN hit / guessed ELSE 0 END AS p,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END AS r FROM classes)""",
        "scores AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM rates)",
    )


def oracle_sql() -> dict[str, str]:
    manifest_cols = ("PassengerId, HomePlanet, CryoSleep, Cabin, Destination, Age, VIP, RoomService, FoodCourt, "
                     "ShoppingMall, Spa, VRDeck, Name, Transported")
    spend = ", ".join(SPEND)
    model_cols = ("HomePlanet, CryoSleep, Destination, Age, VIP, RoomService, FoodCourt, ShoppingMall, Spa, VRDeck, "
                  "Deck, Side, TotalExpenses")
    is_spend = "CASE WHEN TotalExpenses > 0 THEN 'Spent' ELSE 'Not-Spent' END AS Is_Spend"
    z = "round(({c} - avg({c}) OVER ()) / CASE stddev_pop({c}) OVER () WHEN 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) AS {c}"
    split_hash = "('0x' || substr(md5(PassengerId || '|13'), 1, 8))::BIGINT"
    return {
        "scan_manifest": _sql(f"SELECT {manifest_cols} FROM m"),
        "submission": _sql("SELECT PassengerId, coalesce(CryoSleep, false) AS Transported FROM m"),
        "select_model_columns": _sql(
            f"SELECT PassengerId, Transported, {model_cols}, {is_spend}, GroupSize FROM d JOIN groups USING (GroupNumber)",
            _GROUPS.format(source="d")),
        "drop_missing_all": _sql(
            "SELECT PassengerId, HomePlanet, Cabin FROM d WHERE NOT (HomePlanet IS NULL AND Cabin IS NULL)"),
        "drop_missing_any": _sql(
            f"SELECT PassengerId, CryoSleep, VIP, {spend} FROM d WHERE TotalExpenses IS NOT NULL "
            "AND CryoSleep IS NOT NULL AND VIP IS NOT NULL"),
        "filter_null_and_in": _sql(
            "SELECT PassengerId, Deck FROM d WHERE HomePlanet IS NULL AND Deck IN ('A', 'B', 'C', 'T')"),
        "filter_null_and_eq": _sql(
            "SELECT PassengerId, HomePlanet, VIP FROM d WHERE RoomService IS NULL AND HomePlanet = 'Earth' AND VIP"),
        "groups_single_valued": _sql("SELECT GroupNumber, Destination FROM ones", _single_valued("ones", "d")),
        "filter_cryo_missing_total": _sql(
            f"SELECT PassengerId, CryoSleep, {spend} FROM d WHERE TotalExpenses IS NULL AND CryoSleep"),
        "join_group_features": _sql(
            "SELECT PassengerId, VIP, GroupNumber, InGroupNumber, GroupSize, Is_Single FROM d JOIN groups USING (GroupNumber)",
            _GROUPS.format(source="d")),
        "key_overlap": _sql(
            """SELECT 'GroupNumber' AS key, count(*) AS n_common FROM (SELECT GroupNumber FROM d WHERE scoring
  INTERSECT SELECT GroupNumber FROM d WHERE NOT scoring)
UNION ALL SELECT 'Name', count(*) FROM (SELECT Name FROM d WHERE scoring AND Name IS NOT NULL
  INTERSECT SELECT Name FROM d WHERE NOT scoring)"""),
        "lookup_overwrite": _sql(
            "SELECT PassengerId, GroupNumber, l.Destination FROM d LEFT JOIN l USING (GroupNumber)",
            _last_first_seen("l", "d", "Destination")),
        "semi_single_valued": _sql(
            "SELECT PassengerId, GroupNumber, Destination FROM d WHERE GroupNumber IN (SELECT GroupNumber FROM ones)",
            _single_valued("ones", "d")),
        "impute_unique_in_group": _sql(
            "SELECT PassengerId, GroupNumber, coalesce(d.Destination, ones.Destination) AS Destination "
            "FROM d LEFT JOIN ones USING (GroupNumber)",
            _single_valued("ones", "d")),
        "null_profile": _sql(" UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_missing FROM m" for c in manifest_cols.split(", "))),
        "crosstab_size": _crosstab("*"),
        "crosstab_count": _crosstab("Deck"),
        "distinct_per_group": _sql(
            "SELECT GroupNumber, count(DISTINCT Destination) AS UniqueDestinations FROM d WHERE Destination IS NOT NULL "
            "GROUP BY GroupNumber"),
        "fd_check": _sql(" UNION ALL ".join(
            f"""SELECT '{c}' AS dependent, n_values, count(*) AS n_groups FROM (
  SELECT GroupNumber, count(DISTINCT {c}) AS n_values FROM d WHERE {c} IS NOT NULL GROUP BY GroupNumber)
GROUP BY n_values""" for c in ("HomePlanet", "Side", "Destination"))),
        "value_share": _sql(
            """SELECT column_name, value, count(*) AS n,
  round(count(*) * 100.0 / sum(count(*)) OVER (PARTITION BY column_name), 6) AS pct FROM vals GROUP BY column_name, value""",
            """kinds AS (SELECT GroupNumber, count(DISTINCT Destination) AS k FROM d WHERE Destination IS NOT NULL
  GROUP BY GroupNumber)""",
            """vals AS (SELECT 'UniqueDestinations' AS column_name, CAST(k AS VARCHAR) AS value FROM kinds
  UNION ALL SELECT 'CryoSleep', CAST(CryoSleep AS VARCHAR) FROM d WHERE CryoSleep IS NOT NULL)"""),
        "distinct_pairs": _sql("SELECT DISTINCT GroupNumber, Destination FROM d WHERE Destination IS NOT NULL"),
        "mean_spend_by_route_vip": _sql("SELECT * FROM means", _spend_means("d")),
        "mean_spend_pivot": _sql("SELECT JourneyRoute, " + ", ".join(
            f"ceil(nullif(avg({c}) FILTER ({cond}), 0)) AS {c}_{v}" for c in SPEND
            for v, cond in (("false", "NOT VIP"), ("true", "VIP")))
            + " FROM d WHERE JourneyRoute IS NOT NULL AND VIP IS NOT NULL GROUP BY JourneyRoute"),
        "group_size": _sql("SELECT GroupNumber, GroupSize FROM groups", _GROUPS.format(source="d")),
        "group_is_single": _sql("SELECT GroupNumber, Is_Single FROM groups", _GROUPS.format(source="d")),
        "group_mode": _sql(
            """SELECT HomePlanet, Deck, n FROM (
  SELECT HomePlanet, Deck, count(*) AS n, row_number() OVER (PARTITION BY HomePlanet ORDER BY count(*) DESC, Deck DESC) AS r
  FROM d WHERE HomePlanet IS NOT NULL AND Deck IS NOT NULL GROUP BY HomePlanet, Deck) WHERE r = 1"""),
        "transport_rate_by_dim": _sql(
            """SELECT dim, value, Transported, count(*) AS n,
  round(count(*) / sum(count(*)) OVER (PARTITION BY dim, value), 6) AS rate
FROM vals WHERE value IS NOT NULL GROUP BY dim, value, Transported""",
            "vals AS (" + _dim_rows({"JourneyRoute": "JourneyRoute", "CryoSleep": "CryoSleep_label", "Deck": "Deck"},
                                    "Transported_label AS Transported") + ")"),
        "mean_total_by_route_vip": _sql(
            """SELECT JourneyRoute, VIP, round(nullif(avg(TotalExpenses), 0), 6) AS TotalExpenses FROM d
WHERE JourneyRoute IS NOT NULL AND VIP IS NOT NULL GROUP BY JourneyRoute, VIP"""),
        "hierarchy_counts": _sql(
            """SELECT JourneyRoute, VIP, Transported, 3 AS depth, n,
  round(n * 100.0 / sum(n) OVER (PARTITION BY JourneyRoute, VIP), 6) AS pct_parent FROM leaves
UNION ALL SELECT JourneyRoute, VIP, NULL, 2, CAST(sum(n) AS BIGINT),
  round(sum(n) * 100.0 / sum(sum(n)) OVER (PARTITION BY JourneyRoute), 6) FROM leaves GROUP BY JourneyRoute, VIP
UNION ALL SELECT JourneyRoute, NULL, NULL, 1, CAST(sum(n) AS BIGINT),
  round(sum(n) * 100.0 / sum(sum(n)) OVER (), 6) FROM leaves GROUP BY JourneyRoute
UNION ALL SELECT NULL, NULL, NULL, 0, CAST(sum(n) AS BIGINT), NULL FROM leaves""",
            """leaves AS (SELECT JourneyRoute, VIP_label AS VIP, Transported_label AS Transported, count(*) AS n FROM d
  WHERE JourneyRoute IS NOT NULL GROUP BY ALL)"""),
        "value_counts": _sql(
            "SELECT JourneyRoute, count(*) AS n FROM d WHERE JourneyRoute IS NOT NULL GROUP BY JourneyRoute "
            "ORDER BY n DESC, JourneyRoute"),
        "age_histogram_by": _sql(
            'SELECT dim AS "by", value, CAST(floor(Age / 5) * 5 AS DOUBLE) AS bin, count(*) AS n FROM vals '
            "WHERE Age IS NOT NULL GROUP BY ALL",
            "vals AS (" + _dim_rows({c: f"{c}_label" for c in ("Transported", "VIP", "CryoSleep")}, "Age") + ")"),
        "box_stats": _sql(
            " UNION ALL ".join(_box(x, by) for x, by in (
                ("TotalExpenses", "VIP"), ("RatioRoomService", "VIP"), ("Age", "Transported"), ("Age", "VIP"),
                ("Age", "CryoSleep"))),
            _WITH_RATIO),
        "outlier_rows": _sql(
            " UNION ALL ".join(
                f"""SELECT PassengerId, VIP_label AS VIP, '{x}' AS measure, {x} AS value FROM dr JOIN (
  SELECT VIP_label, quantile_cont({x}, [0.25, 0.75]) AS q FROM dr GROUP BY VIP_label) USING (VIP_label)
WHERE {x} < q[1] - 1.5 * (q[2] - q[1]) OR {x} > q[2] + 1.5 * (q[2] - q[1])"""
                for x in ("TotalExpenses", "RatioRoomService")),
            _WITH_RATIO),
        "corr_matrix": _sql("SELECT col_a, col_b, corr FROM (" + " UNION ALL ".join(
            _corr_cell(a, b) if a != b else
            f"SELECT '{a}' AS col_a, '{a}' AS col_b, CAST(1 AS DOUBLE) AS corr" for a in _CORR for b in _CORR) + ")"),
        "sorted_group_profile": _sql(
            """SELECT GroupNumber, count(*) FILTER (Destination = 'DEST-N') AS "DEST-N",
  count(*) FILTER (Destination = 'DEST-R') AS "DEST-R", count(*) FILTER (Destination = 'TRAPPIST-1e') AS "TRAPPIST-1e",
  CAST(count(DISTINCT Destination) AS INTEGER) AS UniqueDestinations
FROM d WHERE Destination IS NOT NULL GROUP BY GroupNumber ORDER BY GroupNumber"""),
        "fill_constant": _sql(
            """SELECT PassengerId, coalesce(HomePlanet, 'Europa') AS HomePlanet, coalesce(CryoSleep, false) AS CryoSleep,
  coalesce(VIP, false) AS VIP, coalesce(Name, 'Unknown') AS Name, coalesce(Side, 'P') AS Side FROM d"""),
        "fill_planet_from_deck": _sql(
            f"SELECT PassengerId, coalesce(HomePlanet, {_PLANET_FROM_DECK}) AS HomePlanet, Deck FROM d"),
        "fill_deck_from_planet": _sql(
            f"SELECT PassengerId, HomePlanet, coalesce(Deck, {_DECK_FROM_PLANET.format(p='HomePlanet')}) AS Deck FROM d"),
        "fill_destination_test": _sql(
            """SELECT PassengerId, HomePlanet, CASE WHEN Destination IS NULL AND HomePlanet IN ('Earth', 'Europa', 'Mars')
  THEN 'TRAPPIST-1e' ELSE Destination END AS Destination FROM d"""),
        "propagate_group_value": _sql(
            """SELECT PassengerId, GroupNumber, a.HomePlanet, b.Side, c.Destination FROM d
LEFT JOIN a USING (GroupNumber) LEFT JOIN b USING (GroupNumber) LEFT JOIN c USING (GroupNumber)""",
            _last_first_seen("a", "d", "HomePlanet"), _last_first_seen("b", "d", "Side"),
            _last_first_seen("c", "d", "Destination")),
        "impute_mean_route_vip": _sql(
            f"SELECT PassengerId, JourneyRoute, VIP, {_each('coalesce(d.{c}, means.{c}) AS {c}')} "
            "FROM d LEFT JOIN means USING (JourneyRoute, VIP)", _spend_means("d")),
        "impute_mean_transform": _sql(
            "SELECT PassengerId, JourneyRoute, VIP, "
            + _each("CASE WHEN JourneyRoute IS NOT NULL AND VIP IS NOT NULL THEN ceil(coalesce(d.{c}, means.{c})) END AS {c}")
            + " FROM d LEFT JOIN means USING (JourneyRoute, VIP)",
            _spend_means("d", zero_is_missing=False, ceil=False)),
        "impute_age_by_planet": _sql(
            """SELECT PassengerId, HomePlanet, CASE WHEN HomePlanet IS NOT NULL THEN ceil(coalesce(d.Age, ages.Age)) END AS Age
FROM d LEFT JOIN ages USING (HomePlanet)""",
            "ages AS (SELECT HomePlanet, avg(Age) AS Age FROM d WHERE HomePlanet IS NOT NULL GROUP BY HomePlanet)"),
        "zero_fill_cryo": _sql(
            "SELECT PassengerId, CryoSleep, "
            + _each("CASE WHEN TotalExpenses IS NULL AND CryoSleep AND {c} IS NULL THEN 0 ELSE {c} END AS {c}") + " FROM d"),
        "impute_global_mean": _sql(
            f"SELECT PassengerId, {_each('round(coalesce({c}, avg({c}) OVER ()), 6) AS {c}')} FROM d"),
        "split_cabin": _sql("SELECT PassengerId, Deck, Num, Side FROM d"),
        "split_passenger_id": _sql("SELECT PassengerId, GroupNumber, InGroupNumber FROM d"),
        "journey_route": _sql("SELECT PassengerId, JourneyRoute FROM d"),
        "total_expenses": _sql("SELECT PassengerId, TotalExpenses FROM d"),
        "spend_ratios": _sql(f"SELECT PassengerId, {_each(_RATIO)} FROM d"),
        "display_labels": _sql(
            "SELECT PassengerId, VIP_label AS VIP, Transported_label AS Transported, CryoSleep_label AS CryoSleep FROM d"),
        "is_spend": _sql(f"SELECT PassengerId, {is_spend} FROM d"),
        "cut_group_size": _sql(
            f"SELECT PassengerId, GroupSize, {_SIZE_CLASS} AS SizeClass FROM d JOIN groups USING (GroupNumber) CROSS JOIN edges",
            _GROUPS.format(source="d"),
            "edges AS (SELECT CAST(min(GroupSize) AS DOUBLE) AS e0, CAST(max(GroupSize) AS DOUBLE) AS e1 FROM groups)"),
        "qcut_age": _sql(
            f"SELECT PassengerId, Age, {_AGE_CLASS} AS AgeClass FROM d CROSS JOIN age_edges", _AGE_EDGES.format(source="d")),
        "standardize_spend": _sql(f"SELECT PassengerId, {_each(z, SCALED)} FROM d"),
        "one_hot": _sql(_one_hot("d", _LEVELS)),
        "one_hot_aligned": _sql(_one_hot("d", {**_LEVELS, "HomePlanet": ("Earth", "Europa")})),
        "holdout_split": _sql(
            f"SELECT PassengerId, Transported, CASE WHEN {split_hash} % 10000 < 1500 THEN 'val' ELSE 'train' END AS split FROM d"),
        "clean_train": _sql("SELECT * FROM clean", *_CLEAN_TRAIN),
        "cleaning_profile": _sql(" UNION ALL ".join(
            f"SELECT {i} AS place, '{step}' AS step, '{c}' AS column_name, count(*) - count({c}) AS n_missing, count(*) AS n_rows FROM {table}"
            for i, (step, table) in enumerate(_STEPS.items()) for c in ("HomePlanet", "CryoSleep", "Destination", "Age", "VIP", *SPEND)), *_CLEAN_TRAIN),
        "clean_test": _sql(f"SELECT * REPLACE ({_each('round({c}, 6) AS {c}', SCALED)}) FROM clean", *_CLEAN_TEST),
        "train_features": _sql(
            f"""SELECT PassengerId, Transported, Is_Single, HomePlanet, CryoSleep, Destination, {_AGE_CLASS} AS Age, VIP,
  {_each(z, SCALED)}, Deck, Side, {is_spend}, {_SIZE_CLASS} AS GroupSize, {_each(_RATIO)}
FROM clean JOIN groups USING (GroupNumber) CROSS JOIN edges CROSS JOIN age_edges""",
            *_CLEAN_TRAIN,
            "members AS (SELECT GroupNumber, split_part(PassengerId, '_', 2) AS InGroupNumber FROM clean)",
            _GROUPS.format(source="members"),
            "edges AS (SELECT CAST(min(GroupSize) AS DOUBLE) AS e0, CAST(max(GroupSize) AS DOUBLE) AS e1 FROM groups)",
            _AGE_EDGES.format(source="clean")),
        "threshold_score": _sql("SELECT PassengerId, score >= 0.5 AS Transported FROM scored", _RULE),
        "accuracy_by_split": _sql(
            """SELECT round(t, 3) AS train_accuracy, round(v, 3) AS val_accuracy, round(t - v, 4) AS difference FROM (
  SELECT avg(CAST(label = prediction AS INTEGER)) FILTER (split = 'train') * 100 AS t,
    avg(CAST(label = prediction AS INTEGER)) FILTER (split = 'val') * 100 AS v FROM ruled)""", _RULE),
        "binary_accuracy": _sql(
            "SELECT round(avg(CAST((score > 0.5) = (label = 1) AS INTEGER)) * 100, 3) AS binary_accuracy FROM scored", _RULE),
        "classification_report": _report(),
        "confusion_matrix": _sql(
            """SELECT label, count(*) FILTER (prediction = 0) AS predicted_0, count(*) FILTER (prediction = 1) AS predicted_1
FROM ruled GROUP BY label""", _RULE),
        "cv_summary": _sql(
            """SELECT count(*) AS folds, round(avg(s) * 100, 3) AS mean, round(stddev_pop(s) * 100, 3) AS std,
  round(avg(s) * 100 + stddev_pop(s) * 100, 3) AS range_high, round(avg(s) * 100 - stddev_pop(s) * 100, 3) AS range_low
FROM (SELECT fold, avg(CAST(label = prediction AS INTEGER)) AS s FROM ruled GROUP BY fold)""", _RULE),
        "oof_fold_assignment": _sql(f"SELECT PassengerId, CAST({split_hash} % 3 AS INTEGER) AS fold FROM d"),
        "gnb_parameters": _sql(" UNION ALL ".join(
            f"""SELECT CAST(Transported AS INTEGER) AS label, '{c}' AS feature,
  round(count(*) / (SELECT count(*) FROM d), 6) AS prior, round(avg({c}), 6) AS mean, round(var_pop({c}), 6) AS variance
FROM d GROUP BY Transported""" for c in ("Age", *SCALED))),
    }
