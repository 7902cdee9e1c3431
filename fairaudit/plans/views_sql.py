"""The audit views as DuckDB SQL, for the oracle side of the checks.

These mirror ``fairaudit.sources.tables`` written independently in SQL; the
driver runs them against the same parquet files.
"""

ORDER_AUDIT = """
order_audit AS (
  SELECT o_orderkey AS row_id, r_name AS region, c_mktsegment AS segment,
         o_orderpriority AS priority, strftime(o_orderdate, '%Y-%m') AS period,
         o_totalprice / CAST(500000 AS DOUBLE) AS score,
         CAST(o_totalprice + (o_orderkey * 7919) % 200000 > 350000 AS INT) AS y_true,
         CAST(o_totalprice + 40000 * n_regionkey > 330000 AS INT) AS y_pred,
         CAST(o_totalprice > 250000 AS INT) AS y_pred_b,
         o_totalprice, c_acctbal, n_regionkey
  FROM orders JOIN customer ON o_custkey = c_custkey
              JOIN nation ON c_nationkey = n_nationkey
              JOIN region ON n_regionkey = r_regionkey
)"""

DOC_AUDIT = """
doc_audit AS (
  SELECT d.doc_id AS row_id, lang, source, n_chars, quality AS y_true,
         CAST(n_chars >= 500 AND toxic = 0 AS INT) AS y_pred
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
)"""

LINE_FEATURES = """
line_features AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS sens,
         CASE WHEN l_linenumber = 3 THEN NULL ELSE l_quantity END AS qty,
         CASE WHEN l_linenumber = 2 THEN NULL ELSE l_linestatus END AS status,
         CASE WHEN l_linenumber = 4 THEN NULL ELSE l_returnflag END AS sens_nullable,
         CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END * 20 + l_quantity AS proxy_qty,
         l_extendedprice AS price, l_discount AS discount, l_tax AS tax, 1 AS constant_f,
         CAST(l_extendedprice > 30000 AS INT) AS y_true
  FROM lineitem
)"""

PART_AUDIT = """
part_audit AS (
  SELECT p_partkey, p_brand, p_type, p_size, p_retailprice,
         CASE WHEN p_size <= 5 THEN 'small' ELSE 'large' END AS grp,
         CAST(p_retailprice > 1500 AS INT) AS y
  FROM part
)"""

EVENT_MONITOR = """
event_monitor AS (
  SELECT event_id, CAST(ts AS TIMESTAMP) AS event_time, event_type AS grp,
         CAST(value > 50 AS INT) AS y
  FROM events
)"""

CONTRIBUTIONS = """
contributions AS (
  SELECT row_id, region, 'price_level' AS feature,
         (o_totalprice - 250000) / CAST(250000 AS DOUBLE) * (2 + n_regionkey) / 10 AS contribution
  FROM order_audit
  UNION ALL
  SELECT row_id, region, 'account_balance', c_acctbal / CAST(10000 AS DOUBLE) * 3 / 10 FROM order_audit
  UNION ALL
  SELECT row_id, region, 'region_offset', CAST(n_regionkey - 2 AS DOUBLE) * 5 / 100 FROM order_audit
)"""

VIEWS = {
    "order_audit": ORDER_AUDIT, "doc_audit": DOC_AUDIT, "line_features": LINE_FEATURES,
    "part_audit": PART_AUDIT, "event_monitor": EVENT_MONITOR, "contributions": CONTRIBUTIONS,
}
DEPENDS = {"contributions": ["order_audit"]}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it names (dependencies first)."""
    order: list[str] = []
    for n in names:
        for d in DEPENDS.get(n, []):
            if d not in order:
                order.append(d)
        if n not in order:
            order.append(n)
    return "WITH " + ",\n".join(VIEWS[n] for n in order) + "\n" + sql
