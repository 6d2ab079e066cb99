"""SQL twins of the registered queries, for an independent engine on the same tables.

Written from the meaning of each report and, where that is possible, in another
form than the Spark side: joins in place of two-step lookups, distinct counts in
place of two aggregates.
"""

from __future__ import annotations

_PERIOD = "period = DATE '1998-05-01'"
_SERVICE = "service = 'Brand#12'"
_KEY = "user_creator"
_NET = "line_type NOT IN ('Credit', 'Refund')"
_USAGE = "line_type = 'Usage'"
_UNMARKED = "resource NOT LIKE '%management%' AND resource NOT LIKE '%overhead%'"


def _items(resource_key: str = "l_partkey") -> str:
    """The cost table as a CTE."""
    k = resource_key
    price, quantity = "CAST(l_extendedprice AS DECIMAL(18,2))", "CAST(l_quantity AS DECIMAL(18,2))"
    discount, tax = "CAST(l_discount AS DECIMAL(18,2))", "CAST(l_tax AS DECIMAL(18,2))"
    return f"""items AS (
      SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS period,
             l_shipdate AS used,
             CASE l_returnflag WHEN 'R' THEN 'Refund' WHEN 'A' THEN 'Credit' WHEN 'N' THEN 'Usage' END AS line_type,
             p_brand AS service,
             p_type AS usage_type,
             CASE WHEN p_size % 5 = 0 THEN '' ELSE CAST(p_size AS VARCHAR) END AS instance_type,
             CASE WHEN {k} % 17 = 0 THEN ''
                  ELSE 'res-' || {k} || CASE WHEN {k} % 19 = 0 THEN '-management'
                                             WHEN {k} % 23 = 0 THEN '-overhead' ELSE '' END END AS resource,
             n_name AS region,
             l_linestatus AS operation,
             {quantity} AS amount,
             {price} AS cost,
             CASE WHEN l_suppkey % 5 = 0 THEN 'ri-' || l_suppkey ELSE '' END AS reservation,
             {price} * {discount} AS unused_upfront,
             {price} * {tax} AS unused_recurring,
             CASE WHEN l_suppkey % 7 = 0 THEN 'sp-' || l_suppkey ELSE '' END AS plan,
             {price} * {quantity} AS commitment,
             {quantity} * {discount} AS used_commitment,
             {discount} AS plan_rate,
             {quantity} * {tax} AS plan_upfront,
             p_name AS product_name,
             CASE WHEN l_partkey % 3 = 1 THEN c_mktsegment END AS creator,
             CASE WHEN l_partkey % 3 <> 0 THEN o_orderpriority END AS priority,
             CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 2 ELSE 1 END AS tag_count
      FROM lineitem
      LEFT JOIN part ON p_partkey = l_partkey
      LEFT JOIN supplier ON s_suppkey = l_suppkey
      LEFT JOIN nation ON n_nationkey = s_nationkey
      LEFT JOIN orders ON o_orderkey = l_orderkey
      LEFT JOIN customer ON c_custkey = o_custkey)"""


def _double(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def _percent(part: str, whole: str) -> str:
    """100 * part / whole in whole hundredths, ties away from 0, by integers of six digits after the point."""
    p, w = (f"CAST(CAST({x} AS DECIMAL(32,6)) * 1000000 AS HUGEINT)" for x in (part, whole))
    hundredths = f"sign({p}) * sign({w}) * ((20000 * abs({p}) + abs({w})) // nullif(2 * abs({w}), 0))"
    return f"CAST({hundredths} AS DOUBLE) / 100"


def _distribution(where: str) -> str:
    def count(flag):
        return f"count(DISTINCT CASE WHEN {flag} THEN resource END)"

    def cost(flag):
        return f"sum(CASE WHEN {flag} THEN cost ELSE 0 END)"

    parts = []
    for flag, n, n_percent, c in (
        ("tagged = 1", "tagged_resources", "tagged_resources_percent", "tagged_cost"),
        ("tagged = 0", "untagged_resources", "untagged_resources_percent", "untagged_cost"),
        ("specific = 1", "resources_with_specific_tag", "specific_tag_resources_percent", "specific_tag_cost"),
    ):
        parts.append(
            f"{count(flag)} AS {n}, {_percent(count(flag), 'count(DISTINCT resource)')} AS {n_percent}, "
            f"{cost(flag)} AS {c}, {_percent(cost(flag), 'sum(cost)')} AS {c}_percent"
        )
    return f"""resources AS (
      SELECT service, resource, max(CASE WHEN tag_count > 0 THEN 1 ELSE 0 END) AS tagged,
             max(CASE WHEN creator <> '' THEN 1 ELSE 0 END) AS specific, sum(cost) AS cost
      FROM items WHERE resource <> '' AND {_USAGE} AND {_UNMARKED} AND {where} GROUP BY 1, 2),
    distribution AS (
      SELECT service, count(DISTINCT resource) AS total_resources, sum(cost) AS total_cost, {', '.join(parts)}
      FROM resources GROUP BY 1),
    totals AS (
      SELECT coalesce(sum(total_resources), 0)::BIGINT AS n, coalesce(sum(total_cost), 0) AS c,
             coalesce(sum(tagged_resources), 0)::BIGINT AS tn, coalesce(sum(tagged_cost), 0) AS tc,
             coalesce(sum(untagged_resources), 0)::BIGINT AS un, coalesce(sum(untagged_cost), 0) AS uc
      FROM distribution),
    summary AS (
      SELECT *, CASE WHEN n > 0 THEN {_percent('tn', 'n')} ELSE 0 END AS np,
                CASE WHEN c > 0 THEN {_percent('tc', 'c')} ELSE 0 END AS cp FROM totals)"""


def _expensive(where: str) -> str:
    return f"""SELECT service, resource AS resource_id, region, instance_type, product_name, usage_type,
        sum(cost) AS cost
      FROM items WHERE tag_count = 0 AND resource <> '' AND {_USAGE} AND {_UNMARKED} AND {where}
      GROUP BY ALL HAVING sum(cost) > 0
      ORDER BY cost DESC, 1, 2, 3, 4, 5, 6 LIMIT 50"""


_COSTS_OF_DISTRIBUTION = ("total_cost", "tagged_cost", "untagged_cost", "specific_tag_cost")


def _reports(where: str) -> dict[str, str]:
    """Reports on the items for which `where` holds."""
    cost = f"{_double('sum(cost)')} AS cost"
    net = f"{_NET} AND {where}"
    distribution_costs = ", ".join(f"{_double(c)} AS {c}" for c in _COSTS_OF_DISTRIBUTION)
    bodies = {
        "cost_by_service": f"""SELECT period AS billing_period, service, {_double('sum(cost)')} AS total_cost
          FROM items WHERE {net} GROUP BY 1, 2 ORDER BY sum(cost) DESC, 1, 2 LIMIT 10""",
        "cost_by_instance_type": f"""SELECT period AS billing_period, usage_type, instance_type, {cost}
          FROM items WHERE {net} AND {_SERVICE} AND instance_type <> ''
          GROUP BY 1, 2, 3 ORDER BY sum(cost) DESC, 1, 2, 3 LIMIT 20""",
        "cost_by_resource_usage": f"""SELECT resource AS resource_id, usage_type, {cost}
          FROM items WHERE {net} AND {_SERVICE} AND resource <> ''
          GROUP BY 1, 2 ORDER BY sum(items.cost) DESC, 1, 2 LIMIT 20""",
        "daily_cost": f"""SELECT CAST(used AS DATE) AS usage_date, {_double('sum(cost)')} AS daily_cost
          FROM items WHERE {net} GROUP BY 1""",
        "cost_by_region": f"SELECT region, {cost} FROM items WHERE {net} GROUP BY 1",
        "reservation_costs": f"""SELECT period AS billing_period, reservation AS reservation_arn,
            {_double('sum(cost)')} AS effective_cost, {_double('sum(unused_upfront)')} AS unused_upfront_fee,
            {_double('sum(unused_recurring)')} AS unused_recurring_fee
          FROM items WHERE {net} AND reservation <> '' GROUP BY 1, 2""",
        "savings_plan_utilization": f"""SELECT period AS billing_period, plan AS savings_plan_arn,
            {_double('sum(cost)')} AS savings_plan_cost, {_double('sum(commitment)')} AS commitment,
            {_double('sum(used_commitment)')} AS used_commitment, {_double('sum(plan_rate)')} AS savings_plan_rate,
            {_double('sum(plan_upfront)')} AS amortized_upfront
          FROM items WHERE {net} AND plan <> '' GROUP BY 1, 2""",
        "usage_and_cost_by_operation": f"""SELECT CAST(used AS DATE) AS usage_date, operation,
            resource AS resource_id, {_double('sum(amount)')} AS usage_amount, {cost}
          FROM items WHERE {net} AND {_SERVICE} GROUP BY 1, 2, 3""",
        "cost_by_tag": f"""SELECT creator AS tag_value, {cost} FROM items
          WHERE {net} AND creator IS NOT NULL AND creator <> '' GROUP BY 1""",
        "untagged_resources": f"""SELECT service, resource AS resource_id, region, {cost}
          FROM items WHERE tag_count = 0 AND resource <> '' AND {_USAGE} AND {where}
          GROUP BY 1, 2, 3 HAVING sum(items.cost) > 0 ORDER BY sum(items.cost) DESC, 1, 2, 3 LIMIT 50""",
        "tag_inventory": f"""SELECT tag_key, tag_value, count(DISTINCT resource) AS resource_count,
            {_double('sum(cost)')} AS total_cost
          FROM (SELECT 'user_creator' AS tag_key, creator AS tag_value, * FROM items
                UNION ALL SELECT 'user_priority', priority, * FROM items)
          WHERE {net} AND resource <> '' AND tag_value <> '' GROUP BY 1, 2""",
        "tagging_status_by_service": f"""SELECT service,
            CASE WHEN tag_count > 0 THEN 'Tagged' ELSE 'Untagged' END AS general_tagging_status,
            CASE WHEN creator <> '' THEN 'Has Tag Key' ELSE 'Missing Tag Key' END AS specific_tag_status,
            count(DISTINCT resource) AS resource_count, {_double('sum(cost)')} AS total_cost
          FROM items WHERE resource <> '' AND {_USAGE} AND {where} GROUP BY 1, 2, 3""",
        "service_resource_detail": f"""SELECT resource AS resource_id, product_name,
            CASE tag_count WHEN 0 THEN '' WHEN 1 THEN 'user_priority=' || priority
                 ELSE 'user_creator=' || creator || ',user_priority=' || priority END AS tags,
            instance_type, region, CASE WHEN tag_count > 0 THEN 'Tagged' ELSE 'Untagged' END AS tagging_status,
            tag_count, CASE WHEN creator <> '' THEN 'Yes' ELSE 'No' END AS has_specific_tag,
            creator AS specific_tag_value, {_double('sum(cost)')} AS monthly_cost
          FROM items WHERE resource <> '' AND {_SERVICE} AND {_USAGE} AND {_UNMARKED} AND {where}
          GROUP BY resource, usage_type, product_name, creator, priority, tag_count, instance_type, region""",
    }
    reports = {name: f"WITH {_items()} {body}" for name, body in bodies.items()}
    reports["expensive_untagged"] = (
        f"WITH {_items()} SELECT * REPLACE ({_double('cost')} AS cost) FROM ({_expensive(where)})"
    )
    reports["tagging_distribution"] = (
        f"WITH {_items()}, {_distribution(where)} SELECT * REPLACE ({distribution_costs}) FROM distribution"
    )
    reports["tagging_summary"] = f"""WITH {_items()}, {_distribution(where)}
      SELECT n AS total_resources, {_double('c')} AS total_cost, tn AS tagged_resources, {_double('tc')} AS tagged_cost,
        un AS untagged_resources, {_double('uc')} AS untagged_cost, {_double('np')} AS tagged_resources_percent,
        {_double('cp')} AS tagged_cost_percent, round(100 - np, 2) AS untagged_resources_percent,
        round(100 - cp, 2) AS untagged_cost_percent FROM summary"""
    return reports


def _week_over_week(current: tuple[str, str], previous: tuple[str, str]) -> str:
    """The report in its join form: two aggregates joined to the distinct places."""

    def costs(first, last):
        return f"""SELECT resource, sum(cost) AS cost FROM items
          WHERE used BETWEEN DATE '{first}' AND DATE '{last}' AND resource <> '' AND {_NET} GROUP BY 1"""

    return f"""WITH {_items('l_suppkey')},
      now AS ({costs(*current)}), before AS ({costs(*previous)}),
      places AS (SELECT DISTINCT resource, service, region FROM items
        WHERE resource <> '' AND used BETWEEN DATE '{previous[0]}' AND DATE '{current[1]}'),
      joined AS (
        SELECT p.resource AS resource_id, service, region, coalesce(b.cost, 0) AS b, coalesce(n.cost, 0) AS n
        FROM places p LEFT JOIN now n ON p.resource = n.resource LEFT JOIN before b ON p.resource = b.resource)
      SELECT resource_id, service, region, {_double('b')} AS prev_week_cost, {_double('n')} AS current_week_cost,
        {_double('n - b')} AS week_over_week_change,
        CASE WHEN b > 0 THEN {_percent('(n - b)', 'b')} WHEN b = 0 AND n > 0 THEN NULL ELSE 0 END AS percentage_change,
        CASE WHEN b = 0 AND n > 0 THEN 'New Resource' WHEN n - b > 0 THEN 'Increasing'
             WHEN n - b < 0 THEN 'Decreasing' ELSE 'Stable' END AS cost_trend
      FROM joined WHERE n > 0 OR b > 0
      ORDER BY n - b DESC, resource_id, service, region LIMIT 20"""


def _text(amount: str) -> str:
    return f"CAST(CAST(round({amount}, 2) AS DECIMAL(38,2)) AS VARCHAR)"


def _monthly() -> dict[str, str]:
    """The parts of the monthly report as text, the way they are written to CSV."""
    distribution = ["service AS service"]
    for c in (
        "total_resources", "tagged_resources", "tagged_resources_percent", "tagged_cost_percent",
        "untagged_resources", "untagged_resources_percent", "untagged_cost_percent",
        "resources_with_specific_tag", "specific_tag_resources_percent", "specific_tag_cost_percent",
    ):
        distribution.append(f"coalesce(CAST({c} AS VARCHAR), 'N/A') AS {c}")
    distribution += [f"{_text(c)} AS {c}" for c in _COSTS_OF_DISTRIBUTION]
    head = f"WITH {_items()}, {_distribution(_PERIOD)}"
    expensive = ", ".join(
        f"coalesce({c}, 'N/A') AS {c}"
        for c in ("service", "resource_id", "region", "product_name", "usage_type")
    )
    return {
        "monthly_report_distribution": f"{head} SELECT {', '.join(distribution)} FROM distribution",
        # An empty text is written as "" and is read back as NULL.
        "monthly_report_expensive": f"""WITH {_items()} SELECT {expensive},
            nullif(coalesce(instance_type, 'N/A'), '') AS instance_type,
            {_text('cost')} AS cost FROM ({_expensive(_PERIOD)})""",
        "monthly_report_summary": f"""{head} SELECT CAST(n AS VARCHAR) AS total_resources, {_text('c')} AS total_cost,
            CAST(tn AS VARCHAR) AS tagged_resources, {_text('tc')} AS tagged_cost,
            CAST(un AS VARCHAR) AS untagged_resources, {_text('uc')} AS untagged_cost,
            CAST({_double('np')} AS VARCHAR) AS tagged_resources_percent,
            CAST({_double('cp')} AS VARCHAR) AS tagged_cost_percent,
            {_text('100 - np')} AS untagged_resources_percent, {_text('100 - cp')} AS untagged_cost_percent
          FROM summary""",
    }


_ORDER_ROW = """o_orderkey, o_custkey, o_orderstatus, o_totalprice,
    CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority"""


def _integer_type(column: str) -> str:
    return f"CASE WHEN max({column}) > 2147483647 THEN 'bigint' ELSE 'int' END"


def _ingest() -> dict[str, str]:
    return {
        "csv_roundtrip": f"SELECT {_ORDER_ROW} FROM orders",
        "retyped_rows": f"SELECT {_ORDER_ROW} FROM orders",
        "retyped_once": f"SELECT {_ORDER_ROW} FROM orders",
        "registered_table": f"SELECT {_ORDER_ROW} FROM orders",
        "misfit_rows": """SELECT false AS misfit, count(*) AS rows, CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM orders
          UNION ALL SELECT true, count(*), CAST(sum(c_custkey) AS BIGINT) FROM customer""",
        "schema_report": f"""WITH t AS (SELECT count(*) AS records, {_integer_type('o_orderkey')} AS k,
            {_integer_type('o_custkey')} AS c FROM orders)
          SELECT 1 AS position, 'o_orderkey' AS name, k AS type, records FROM t
          UNION ALL SELECT 2, 'o_custkey', c, records FROM t
          UNION ALL SELECT 3, 'o_orderstatus', 'string', records FROM t
          UNION ALL SELECT 4, 'o_totalprice', 'double', records FROM t
          UNION ALL SELECT 5, 'o_orderdate', 'timestamp', records FROM t
          UNION ALL SELECT 6, 'o_orderpriority', 'string', records FROM t""",
        "dataset_names": """SELECT page_id, url AS key,
            split_part(list_last(string_split(url, '/')), '.', 1) || '_20240131123000' AS dataset FROM pages""",
        "rendered_amounts": """SELECT c_custkey, CAST(CAST(c_acctbal AS DECIMAL(38,2)) AS VARCHAR) AS balance,
            CASE WHEN c_mktsegment = 'MACHINERY' THEN 'N/A' ELSE c_mktsegment END AS segment FROM customer""",
        "usage_between_dates": """SELECT CAST(ts AS DATE) AS usage_date, count(*) AS events FROM events
          WHERE ts BETWEEN DATE '2024-01-02' AND DATE '2024-01-28' GROUP BY 1""",
        "schema_changes": f"""WITH t AS (SELECT {_integer_type('o_orderkey')} AS k, {_integer_type('o_custkey')} AS c
            FROM orders)
          SELECT 'o_orderkey' AS name, k AS old_type, 'bigint' AS new_type,
            CASE WHEN k = 'bigint' THEN 'same' ELSE 'retyped' END AS change FROM t
          UNION ALL SELECT 'o_custkey', c, 'bigint', CASE WHEN c = 'bigint' THEN 'same' ELSE 'retyped' END FROM t
          UNION ALL SELECT 'o_orderstatus', 'string', NULL, 'missing'
          UNION ALL SELECT 'o_totalprice', 'double', 'double', 'same'
          UNION ALL SELECT 'o_orderdate', 'timestamp', 'timestamp_ntz', 'retyped'
          UNION ALL SELECT 'o_orderpriority', 'string', 'string', 'same'
          UNION ALL SELECT 'o_note', NULL, 'string', 'added'""",
        "evolved_table": """SELECT o_orderkey, o_orderstatus,
            CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority,
            CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END AS part FROM orders""",
        "retyped_table": """SELECT CASE WHEN o_orderstatus = 'F' THEN '' ELSE 'o' END || o_orderkey AS o_orderkey,
            CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE floor(o_totalprice) END AS o_totalprice, o_orderstatus
          FROM orders""",
        "partition_changes": """WITH counted AS (
            SELECT CAST(left(o_orderpriority, 1) AS INTEGER) AS rank, count(*) AS rows FROM orders GROUP BY 1)
          SELECT rank, CASE rank WHEN 1 THEN 'vanished' WHEN 3 THEN 'added' END AS change,
            CASE WHEN rank > 1 THEN rows END AS rows FROM counted WHERE rank <= 3""",
        "stream_ingest": f"""SELECT {_ORDER_ROW}, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS run,
            CASE WHEN o_orderstatus = 'F' THEN 'first run' ELSE 'second+run' END AS arrived_in,
            true AS named_after_file FROM orders""",
        "converted_table": f"SELECT {_ORDER_ROW} FROM orders",
        "bookmarked_orders": """SELECT o_orderkey, o_orderstatus,
            CASE WHEN o_orderkey < 1000 THEN o_totalprice + 1000 ELSE o_totalprice END AS o_totalprice,
            0 AS files_again, 2 AS files_last FROM orders""",
        "sampled_rows": "SELECT least(count(*), 5)::BIGINT AS rows, 0::BIGINT AS strange FROM orders",
        "refused_inputs": "SELECT * FROM (VALUES ('all', false), ('none', true)) t(input, refused)",
        "batch_files": """SELECT page_id, CASE WHEN page_id // 10 % 5 = 0 THEN 'test' ELSE 'train' END AS split, url
          FROM pages WHERE page_id // 10 % 3 <> 0""",
    }


def _page_text(html: str) -> str:
    """Page to text by regular expressions; the pages hold four kinds of references."""
    dropped = "(?is)<!--.*?-->|" + "|".join(
        f"<{e}\\b[^>]*>.*?</{e}\\s*>" for e in ("script", "style", "head", "title")
    ) + "|<![^>]*>"
    text = f"regexp_replace(regexp_replace({html}, '{dropped}', chr(65534), 'g'), '</?[a-zA-Z][^>]*>', chr(65534), 'g')"
    for reference, character in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        # The semicolon may be missing where the name ends anyway.
        text = f"regexp_replace({text}, '{reference[:-1]}(?:;|\\b)', '{character}', 'g')"
    return f"replace({text}, chr(65534), '')"


def _corpus() -> dict[str, str]:
    text = _page_text("html")
    return {
        "page_texts": f"SELECT page_id, {text} AS text FROM pages",
        "text_files": f"SELECT page_id, {text} AS text FROM pages",
        "pages_to_corpus": f"""SELECT page_id, {text} AS text
          FROM (SELECT * FROM pages ORDER BY md5(page_id || ':0'), page_id LIMIT 20)""",
        "odd_page_texts": f"SELECT page_id, 'shopxkept' || {text} AS text FROM pages",
        "page_sample": "SELECT page_id, url FROM pages ORDER BY md5(page_id || ':42'), page_id LIMIT 100",
    }


def _labels() -> dict[str, str]:
    table = """WITH ranked AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_id // 100 ORDER BY value DESC, event_type, event_id) AS r
        FROM events WHERE value >= 96),
      written AS (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS w
        FROM ranked WHERE r <= 5)
      SELECT user_id AS image_id, event_type AS tag, value AS conf, event_id AS seq FROM written WHERE w = 1"""

    def best(max_labels, min_confidence):
        return f"""WITH found AS (
            SELECT vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
          sure AS (
            SELECT vec_id, 'label_' || i AS name, CAST(abs(x) AS DOUBLE) * 1000 AS confidence FROM found
            WHERE CAST(abs(x) AS DOUBLE) * 1000 >= {min_confidence}),
          ranked AS (
            SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY confidence DESC, name) AS r FROM sure
            QUALIFY r <= {max_labels})"""

    return {
        "label_table": table,
        "label_upsert_stream": table,
        "label_state_stream": table,
        "label_lookup": """SELECT user_id AS image_id, event_type AS tag, value AS confidence, event_id AS seq FROM events
          WHERE user_id % 10 = 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""",
        "label_listing": f"""{best(10, 95)}
          SELECT vec_id AS image_id, CAST(r AS INTEGER) AS rank, name, confidence FROM ranked""",
        "response_items": f"""{best(5, 96)}
          SELECT vec_id AS image_id, name AS tag, confidence AS conf, vec_id AS seq FROM ranked""",
    }


def _features() -> dict[str, str]:
    images = """images AS (SELECT vec_id, label,
        list_transform(embedding, lambda x: CAST(floor(abs(CAST(x AS DOUBLE)) * 1000) AS BIGINT) % 256) AS p
      FROM embeddings)"""
    train = "CASE WHEN substr(md5({0} || ':42'), 1, 8) < 'cccccccc' THEN 'train' ELSE 'test' END"

    def pick(start, n):
        return f"CAST(CAST('0x' || substr(h, {start}, 8) AS BIGINT) % {n} AS INTEGER)"

    return {
        "image_batches": f"""WITH {images}
          SELECT CASE WHEN vec_id // 500 % 5 = 4 THEN 'test' ELSE 'train' END AS split, label,
            array_to_string(p, ',') AS pixels FROM images""",
        # Cell i of the interleaved image is channel i % 4 of pixel i // 4.
        "prepare_images": f"""WITH {images}
          SELECT vec_id, CAST(i AS INTEGER) AS position,
            CAST(CAST(p[(i % 4) * 16 + i // 4 + 1] / 255.0::DOUBLE AS FLOAT) AS DOUBLE) AS value
          FROM images, range(64) t(i)""",
        "one_hot_labels": """SELECT vec_id, CAST(i AS INTEGER) AS position,
            CASE WHEN i = label THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS value FROM embeddings, range(10) t(i)""",
        "augment_images": f"""WITH {images},
          choices AS (SELECT vec_id, p, CAST(c AS INTEGER) AS copy, md5(vec_id || ':7:' || c) AS h
            FROM images, range(1, 3) t(c)),
          variants AS (SELECT vec_id, p, copy, {pick(1, 2)} = 1 AS flip, {pick(9, 3)} - 1 AS dx, {pick(17, 3)} - 1 AS dy
            FROM choices),
          cells AS (SELECT *, i // 16 AS r, (i // 4) % 4 AS c, i % 4 AS ch FROM variants, range(64) t(i)),
          sources AS (SELECT *, least(greatest(r - dy, 0), 3) AS sr, least(greatest(c - dx, 0), 3) AS sc FROM cells)
          SELECT vec_id, copy, flip, dx, dy, CAST(i AS INTEGER) AS position,
            CAST(p[(sr * 4 + CASE WHEN flip THEN 3 - sc ELSE sc END) * 4 + ch + 1] AS DOUBLE) AS value FROM sources""",
        "array_shapes": f"""SELECT {train.format('vec_id')} AS split, count(*) AS rows,
            min(CAST(len(embedding) AS INTEGER)) AS min_pixels, max(CAST(len(embedding) AS INTEGER)) AS max_pixels,
            10 AS min_label, 10 AS max_label FROM embeddings GROUP BY 1""",
        "appended_batches": f"SELECT o_orderkey, o_totalprice, {train.format('o_orderkey')} AS split FROM orders",
        "train_test_split": f"SELECT o_orderkey, {train.format('o_orderkey')} AS split FROM orders",
        "split_counts": f"SELECT {train.format('o_orderkey')} AS split, count(*) AS rows FROM orders GROUP BY 1",
        "matrix_csv": """SELECT l_quantity AS f0, l_extendedprice AS f1, l_discount AS f2, l_tax AS f3
          FROM lineitem""",
        "rounded_predictions": """SELECT l_orderkey, l_linenumber, CAST(round_even(l_quantity / 2, 0) AS DOUBLE) AS result
          FROM lineitem""",
        "evaluation": """SELECT count(*) AS rows,
            round(avg(-ln(CASE l_returnflag WHEN 'A' THEN 0.8::DOUBLE - l_discount
                WHEN 'N' THEN 0.1::DOUBLE + l_discount ELSE 0.1::DOUBLE END)), 9) AS loss,
            round(avg(CASE WHEN l_linenumber % 3 = CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END
                THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS accuracy
          FROM lineitem""",
        "json_matrix": """SELECT l_orderkey, 0 AS position, l_quantity AS x, l_extendedprice AS y FROM lineitem
          UNION ALL SELECT l_orderkey, 1, l_discount, l_tax FROM lineitem""",
    }


def _models() -> dict[str, str]:
    """What models must learn: classes that follow from a threshold, without an error."""
    test = "substr(md5(l_orderkey || ':42'), 1, 8) >= 'cccccccc'"
    label = "CASE WHEN l_discount <= 0.03::DOUBLE THEN 0 WHEN l_discount <= 0.06::DOUBLE THEN 1 ELSE 2 END"
    return {
        "boosted_trees_scores": f"""SELECT l_orderkey, {label} AS label, {label}::DOUBLE AS prediction,
            1.0::DOUBLE AS probability_sum FROM lineitem WHERE {test}""",
        "json_scores": f"""SELECT l_orderkey, 0 AS position, {label}::DOUBLE AS prediction,
            CASE {label} WHEN 0 THEN '1.0,0.0,0.0' WHEN 1 THEN '0.0,1.0,0.0' ELSE '0.0,0.0,1.0' END AS result
          FROM lineitem WHERE {test}""",
        "model_metrics": f"""SELECT count(*) AS rows, 1.0::DOUBLE AS accuracy, true AS sure, 0::BIGINT AS differences
          FROM lineitem WHERE {test}""",
        "binary_model_metrics": f"""SELECT count(*) AS rows, 1.0::DOUBLE AS accuracy, true AS sure
          FROM lineitem WHERE {test}""",
    }


def all_queries() -> dict[str, str]:
    return {
        **{f"stored_{name}": _reports(_PERIOD)[name] for name in ("cost_by_service", "tagging_distribution")},
        "stored_current_period": f"SELECT service, total_cost FROM ({_reports(_PERIOD)['cost_by_service']})",
        **_models(),
        **_reports(_PERIOD),
        **{f"{name}_all_periods": sql for name, sql in _reports("true").items()},
        "month_over_month": f"""WITH {_items()}, c AS (
            SELECT sum(CASE WHEN period = DATE '1998-05-01' AND {_NET} THEN cost ELSE 0 END) AS now,
                   sum(CASE WHEN period = DATE '1998-04-01' AND {_NET} THEN cost ELSE 0 END) AS before
            FROM items WHERE period IN (DATE '1998-05-01', DATE '1998-04-01'))
          SELECT '1998-05' AS current_month, '1998-04' AS previous_month, {_double('now')} AS current_cost,
            {_double('before')} AS previous_cost, {_double('now - before')} AS cost_difference FROM c""",
        "week_over_week": _week_over_week(("1998-05-11", "1998-05-17"), ("1998-05-04", "1998-05-10")),
        "week_over_week_long_spans": _week_over_week(("1998-07-01", "2001-12-31"), ("1995-01-01", "1998-06-30")),
        **_monthly(),
        **_ingest(),
        **_corpus(),
        **_labels(),
        **_features(),
    }
