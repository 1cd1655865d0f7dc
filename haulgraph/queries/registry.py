"""One decorator registers a query with its SQL; fragments of SQL give the network view."""

QUERIES: dict = {}
SQL: dict = {}

LAT, LON = "(((({0}) * 7919) % 12001) / 100::DOUBLE - 60::DOUBLE)", "(((({0}) * 104729) % 36000) / 100::DOUBLE - 180::DOUBLE)"


def lat(key: str) -> str:
    return LAT.format(key)


def lon(key: str) -> str:
    return LON.format(key)


def haversine(a: str, b: str, c: str, d: str) -> str:
    h = f"pow(sin(radians(({c}) - ({a})) / 2), 2.0::DOUBLE) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2.0::DOUBLE)"
    return f"ceil(12742000::DOUBLE * asin(sqrt(least({h}, 1::DOUBLE))))"


VIEWS = {
    "countries": "countries AS (SELECT n_nationkey AS nationkey, n_name AS country, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey)",
    "nodes": f"""nodes AS (SELECT s_suppkey AS key, CASE s_suppkey % 3 WHEN 0 THEN 'port' WHEN 1 THEN 'gas_node' ELSE 'liquid_node' END AS node_type,
 CASE s_suppkey % 3 WHEN 1 THEN 'PG_' || nationkey WHEN 2 THEN 'PL_' || nationkey END AS graph_id, {lat("s_suppkey")} AS lat, {lon("s_suppkey")} AS lon,
 country, continent, s_suppkey % 7 <> 0 AS convertible FROM supplier JOIN countries ON s_nationkey = nationkey)""",
    "edges": f"""edges AS (SELECT graph_id, src, dst, {haversine(lat("src"), lon("src"), lat("dst"), lon("dst"))} AS distance_m
 FROM (SELECT graph_id, key AS src, lead(key) OVER (PARTITION BY graph_id ORDER BY key) AS dst FROM nodes WHERE graph_id IS NOT NULL) WHERE dst IS NOT NULL)""",
    "starts": f"starts AS (SELECT c_custkey AS start_id, {lat('c_custkey')} AS lat, {lon('c_custkey')} AS lon, abs(c_acctbal) / 100 + 20 AS cost, c_nationkey AS nationkey FROM customer)",
    "branches": "branches AS (SELECT o_orderkey AS branch_id, o_custkey % 97 AS node, o_orderpriority AS commodity, o_totalprice AS cost, o_custkey AS start_id, o_orderstatus AS status FROM orders)",
    "steps": "steps AS (SELECT l_orderkey AS route, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_suppkey AS node, l_returnflag AS flag, l_linestatus AS status, l_extendedprice AS total, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem)",
    "options": "options AS (SELECT l_orderkey AS parent, l_linenumber AS n, l_suppkey AS node, l_quantity * 1000 AS distance_m, l_discount AS rate, l_tax AS loss, l_returnflag AS mean FROM lineitem)",
    "telemetry": "telemetry AS (SELECT event_id, event_type AS phase, user_id % 5 AS method, value AS runtime_s, k AS before, k % 50 AS after, k - k % 50 AS removed FROM (SELECT *, (props->>'$.k')::BIGINT AS k FROM events))",
}
NEEDS = {"nodes": ["countries"], "edges": ["countries", "nodes"]}


def views(*names: str) -> str:
    found: list[str] = []
    for n in names:
        found += [x for x in (*NEEDS.get(n, []), n) if x not in found]
    return "WITH RECURSIVE " + ", ".join(VIEWS[n] for n in found)


def query(sql: str | None = None, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            SQL[key] = sql
        return f

    return register
