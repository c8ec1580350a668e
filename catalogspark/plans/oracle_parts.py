"""Common table expressions in DuckDB SQL for the tables of ``sources.adapters``; attributes are columns of their own."""

EVENTS = """
    ev AS (
        SELECT 'user:' || user_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rev, event_type AS type,
               'ns' || (user_id % 5) AS namespace, 'User ' || user_id || ' ' || event_type AS name, event_type || ' by user ' || user_id AS description,
               CASE event_type WHEN 'signup' THEN '' WHEN 'error' THEN NULL ELSE CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR) END AS version,
               event_type AS tag, CASE WHEN value < 10 THEN 'small' ELSE 'large' END AS tag2,
               CASE WHEN event_type IN ('click', 'view') THEN 'browse' WHEN event_type = 'purchase' THEN 'pay' END AS capability, strftime(ts, '%a') AS env,
               CASE WHEN event_type = 'error' THEN 'disabled' ELSE 'active' END AS status,
               CASE WHEN value >= 90 THEN 'restricted' WHEN event_type = 'signup' THEN 'internal' ELSE 'public' END AS visibility,
               CASE WHEN value >= 90 THEN event_type END AS allowed_group, CASE WHEN event_type = 'click' THEN 'app/' || user_id END AS endpoint,
               CASE WHEN event_type <> 'error' THEN CAST(user_id AS VARCHAR) END AS owner, props AS meta, date_trunc('millisecond', ts) AS updated_at, event_id FROM events),
    ent AS (SELECT * FROM ev WHERE event_id % 50 <> 49),
    latest AS (SELECT * FROM ent QUALIFY row_number() OVER (PARTITION BY id ORDER BY rev DESC) = 1),
    chg AS (SELECT event_id AS seq, id, rev, CASE WHEN type = 'purchase' THEN 'set_status' ELSE 'publish' END AS change_type FROM ev)"""


def _document(rev: int) -> str:
    tags = "'revised' AS tag, NULL AS tag2, 'desk' AS env" if rev == 2 else (
        "source AS tag, CASE WHEN n_chars < 700 THEN 'short' WHEN n_chars < 2500 THEN 'page' ELSE 'long' END AS tag2, CASE WHEN n_chars > 4000 THEN 'archive' ELSE 'shelf' END AS env"
    )
    later, which = (" + INTERVAL 1 DAY", "WHERE lang <> 'en'") if rev == 2 else ("", "")
    return f"""SELECT 'doc:' || lang || ':' || doc_id AS id, {rev} AS rev, lang AS type, source AS namespace, 'Document ' || doc_id AS name, text AS description,
        CASE WHEN lang = 'es' THEN '' WHEN n_chars >= 700 THEN (n_chars // 1000) || '.0' END AS version, {tags},
        CASE WHEN lang = 'en' THEN 'quote' ELSE 'translate' END AS capability, CASE WHEN n_chars < 100 THEN 'disabled' ELSE 'active' END AS status,
        CASE WHEN source IN ('src3', 'src11') THEN 'restricted' WHEN lang = 'es' THEN 'internal' ELSE 'public' END AS visibility,
        CASE WHEN source IN ('src3', 'src11') THEN lang END AS allowed_group, CASE WHEN lang <> 'fr' THEN source || '/' || doc_id END AS endpoint,
        CASE WHEN lang <> 'de' THEN source END AS owner, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (n_chars % 97){later} AS updated_at, doc_id
        FROM documents {which}"""


DOCS = f"""
    dent AS ({_document(1)} UNION ALL {_document(2)}),
    dlat AS (SELECT * FROM dent QUALIFY row_number() OVER (PARTITION BY id ORDER BY rev DESC) = 1)"""

TOKENS = """
    tok AS (
        SELECT id, 'eq' AS kind, 'top' AS scope, k AS key, v AS value
        FROM (SELECT id, unnest(['id','type','name','namespace','version','rev']) AS k, unnest([id, type, name, namespace, version, CAST(rev AS VARCHAR)]) AS v FROM dlat) WHERE v <> ''
        UNION ALL
        SELECT id, 'present', 'top', k, NULL
        FROM (SELECT id, unnest(['id','type','name','namespace','version','rev']) AS k, unnest([id, type, name, namespace, version, CAST(rev AS VARCHAR)]) AS v FROM dlat) WHERE v <> ''
        UNION ALL
        SELECT id, 'eq', 'attr', k, v FROM (
            SELECT id, unnest(['tag','tag','capability','env','status','visibility','allowed_group','endpoint','owner']) AS k,
                   unnest([tag, tag2, capability, env, status, visibility, allowed_group, endpoint, owner]) AS v FROM dlat) WHERE v IS NOT NULL
        UNION ALL
        SELECT id, 'present', 'attr', k, NULL FROM (
            SELECT id, unnest(['tag','tag','capability','env','status','visibility','allowed_group','endpoint','owner']) AS k,
                   unnest([tag, NULL, capability, env, status, visibility, allowed_group, endpoint, 'x']) AS v FROM dlat) WHERE v IS NOT NULL)"""

REQUESTERS = """
    req0 AS (
        SELECT c_custkey AS requester, c_acctbal >= 0 AS authenticated,
               CASE c_mktsegment WHEN 'MACHINERY' THEN 'en,click' WHEN 'BUILDING' THEN 'de, fr' WHEN 'AUTOMOBILE' THEN ' fr ,,purchase' WHEN 'HOUSEHOLD' THEN 'law' ELSE '' END AS g
        FROM customer),
    req AS (
        SELECT requester, authenticated,
               CASE WHEN authenticated THEN list_distinct(list_filter(list_transform(string_split(g, ','), lambda x: trim(x)), lambda x: x <> '')) ELSE [] END AS groups
        FROM req0)"""

COMMANDS = """
    cmd AS (
        SELECT o_orderkey AS ord, CASE WHEN o_orderkey % 3 = 0 THEN 'set_status' ELSE 'publish' END AS op, 'cust:' || o_custkey || CASE WHEN o_orderkey % 5 = 0 THEN ':new' ELSE '' END AS id,
               o_orderpriority AS tag,
               CASE o_orderstatus WHEN 'P' THEN 'active' WHEN 'O' THEN 'deprecated' ELSE 'disabled' END AS status,
               CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS reason FROM orders),
    base AS (
        SELECT 'cust:' || c_custkey AS id, c_custkey % 3 + 1 AS rev, c_name AS name, CASE WHEN c_custkey % 2 = 0 THEN 'stored' END AS reason
        FROM customer)"""

BENCH = """
    runs AS (
        SELECT 'd' || (user_id % 2) AS dataset, 'default' AS scenario, 't' || (user_id % 3) AS target, 'http://' || event_id AS endpoint, event_type AS suite,
               value AS p50_ms, value * 2 AS p95_ms, value * 3 AS p99_ms, value + 1 AS req_per_sec_avg, event_id AS ts FROM events),
    counted AS (
        SELECT * FROM runs QUALIFY count(*) OVER (PARTITION BY dataset, target, suite) = 1 OR row_number() OVER (PARTITION BY dataset, target, suite ORDER BY ts) > 1),
    report AS (
        SELECT dataset, scenario, target, suite, count(*) AS samples, arg_min(endpoint, ts) AS endpoint, quantile_cont(p50_ms, 0.5) AS p50_ms,
               quantile_cont(p95_ms, 0.5) AS p95_ms, quantile_cont(p99_ms, 0.5) AS p99_ms, quantile_cont(req_per_sec_avg, 0.5) AS req_per_sec_avg
        FROM counted GROUP BY ALL)"""
