"""DuckDB reference SQL for the correctness gate.

Each entry is an independent SQL statement of what the matching Spark
plan in ``leadspark.queries`` computes, over the driver's pre-registered
views. The domain views are prepended as CTEs; DuckDB only evaluates the
ones a statement uses.
"""

from __future__ import annotations

from .fixtures import PRICE_ROWS, PROMPT_ROWS, SETTINGS_ROWS, SUBSCRIPTION_ROWS


def _lit(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, (int, float)):
        return repr(float(v)) + "e0" if isinstance(v, float) else str(v)
    if isinstance(v, list):
        return "[" + ", ".join(_lit(x) for x in v) + "]"
    return "'" + str(v).replace("'", "''") + "'"


def _values(rows):
    return ",\n  ".join("(" + ", ".join(_lit(v) for v in r) + ")" for r in rows)


GEO = """SELECT n_nationkey, n_name AS company, r_name AS client
  FROM nation JOIN region ON n_regionkey = r_regionkey"""

CONTACTS = """SELECT g.client, c_custkey * 2 AS src_row,
       CASE WHEN c_custkey % 50 = 0 THEN '  ' || split_part(c_name, '#', 1) || ' '
            ELSE split_part(c_name, '#', 1) END AS first_name,
       CASE WHEN c_custkey % 97 = 0 THEN NULL ELSE split_part(c_name, '#', 2) END AS last_name,
       g.company,
       CASE WHEN c_custkey % 10 = 0 THEN 'Freelance ' || c_mktsegment
            WHEN c_custkey % 10 = 1 THEN NULL ELSE c_mktsegment END AS position,
       CAST(NULL AS VARCHAR) AS url
  FROM customer JOIN geo g ON c_nationkey = g.n_nationkey
  UNION ALL
  SELECT g.client, s_suppkey * 2 + 1, split_part(s_name, '#', 1), split_part(s_name, '#', 2),
         g.company, 'Supplier', CAST(NULL AS VARCHAR)
  FROM supplier JOIN geo g ON s_nationkey = g.n_nationkey"""

HISTORY = """SELECT g.client, o_orderkey AS search_id,
       split_part(c_name, '#', 1) AS first_name, split_part(c_name, '#', 2) AS last_name,
       g.company, o_orderdate AS search_date,
       o_orderkey % 11 AS novelty_score,
       CAST(floor(o_orderkey / 11.0) AS BIGINT) % 3 AS activity_score,
       CAST(floor(o_orderkey / 33.0) AS BIGINT) % 11 AS services_need_score,
       o_orderkey % 11 + CAST(floor(o_orderkey / 11.0) AS BIGINT) % 3
         + CAST(floor(o_orderkey / 33.0) AS BIGINT) % 11 AS total_score,
       CASE WHEN o_orderstatus = 'F' AND o_orderdate < TIMESTAMP '2001-07-25 00:00:00'
            THEN o_orderdate + INTERVAL 7 DAY END AS email_date
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN geo g ON c_nationkey = g.n_nationkey"""

HISTORY_T = """SELECT h.*, d.text AS search_results
  FROM history h LEFT JOIN documents d ON d.doc_id = h.search_id"""

CONSUMPTION = """SELECT r_name AS client, event_id AS usage_id, ts AS search_date,
       'search' AS function, event_type AS model,
       CAST(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END AS BIGINT) AS search_calls,
       CAST(floor(value * 1000) AS BIGINT) AS input_tokens,
       CAST(floor(value * 100) AS BIGINT) AS output_tokens
  FROM events JOIN region ON r_regionkey = user_id % 5"""

PRICING = f"""SELECT ord, model, CAST(s AS TIMESTAMP) AS start_date, CAST(e AS TIMESTAMP) AS end_date,
       input_price, output_price, search_price
  FROM (VALUES
  {_values(PRICE_ROWS)}
  ) AS t(ord, model, s, e, input_price, output_price, search_price)"""

SUBSCRIPTIONS = f"""SELECT client, CAST(s AS DATE) AS start_date, CAST(e AS DATE) AS end_date, monthly_budget
  FROM (VALUES
  {_values(SUBSCRIPTION_ROWS)}
  ) AS t(client, s, e, monthly_budget)"""

SETTINGS = f"""SELECT client, batch_size, mini_batch_size, max_emails, max_tavily_searches,
       max_pplx_searches, llm_search, llm_email, email_days_of_week, send_proposed_emails
  FROM (VALUES
  {_values(SETTINGS_ROWS)}
  ) AS t(client, batch_size, mini_batch_size, max_emails, max_tavily_searches,
         max_pplx_searches, llm_search, llm_email, email_days_of_week, send_proposed_emails)"""

PROMPTS = f"""SELECT * FROM (VALUES
  {_values(PROMPT_ROWS)}
  ) AS t(client, name, body)"""

BASE = [("geo", GEO), ("contacts", CONTACTS), ("history", HISTORY), ("history_t", HISTORY_T),
        ("consumption", CONSUMPTION), ("pricing", PRICING), ("subscriptions", SUBSCRIPTIONS),
        ("settings", SETTINGS)]


def with_views(body: str, extra: list[tuple[str, str]] | None = None) -> str:
    ctes = BASE + list(extra or [])
    head = ",\n".join(f"{n} AS (\n{s}\n)" for n, s in ctes)
    return f"WITH {head}\n{body}"


# --- shared CTEs -----------------------------------------------------------

PRICE_PICK = [
    ("cand", """SELECT u.usage_id, p.ord,
       (CASE WHEN p.end_date IS NULL OR p.end_date >= u.search_date THEN 1 ELSE 0 END) AS valid
  FROM consumption u JOIN pricing p ON u.model = p.model AND p.start_date <= u.search_date"""),
    ("pick", "SELECT usage_id, arg_max(ord, valid * 1000000000 + ord) AS price_ord FROM cand GROUP BY usage_id"),
    ("priced", """SELECT u.*, k.price_ord, p.input_price, p.output_price, p.search_price
  FROM consumption u LEFT JOIN pick k ON u.usage_id = k.usage_id
  LEFT JOIN pricing p ON p.ord = k.price_ord"""),
    ("detail", """SELECT client, usage_id, search_date AS date, model, price_ord,
       (CASE WHEN input_price IS NOT NULL AND input_price <> 0
             THEN CAST(input_tokens AS DECIMAL(13,0)) * CAST(input_price AS DECIMAL(15,9)) * 0.000001 ELSE 0 END
      + CASE WHEN output_price IS NOT NULL AND output_price <> 0
             THEN CAST(output_tokens AS DECIMAL(13,0)) * CAST(output_price AS DECIMAL(15,9)) * 0.000001 ELSE 0 END
      + CASE WHEN search_price IS NOT NULL AND search_price <> 0
             THEN CAST(search_calls AS DECIMAL(13,0)) * CAST(search_price AS DECIMAL(15,9)) ELSE 0 END) AS money,
       (price_ord IS NOT NULL AND (input_price IS NULL OR output_price IS NULL OR search_price IS NULL))
         AS price_missing
  FROM priced"""),
]
