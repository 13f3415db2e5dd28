"""The same results in plain SQL, for checking the queries with another engine."""

# Page size of the records and first id of the schemas, as in the engine's defaults.
PAGE = 10_000

CHASERS = """
chasers AS (
  SELECT 'user-' || user_id AS key, event_id AS seq, 'Chaser' AS kind, event_type AS name,
         CAST(event_id AS VARCHAR) AS id, epoch_us(ts) // 1000 AS sent,
         CAST(round(value * 100) AS BIGINT) AS ttl,
         CASE WHEN event_type <> 'signup'
              THEN epoch_us(ts) // 1000 - CAST(round(value * 100) AS BIGINT) END AS previous
  FROM events)"""

BILLING = """
unnumbered AS (
  SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'INV-' ELSE 'BILL-' END || o_orderkey AS key,
         epoch_us(o_orderdate) // 1000 AS happened, 0 AS rank, 0 AS line,
         0 AS part, 0 AS supp, 'Bill' AS kind, 'ORD-' || o_orderkey AS id,
         'CUST-' || o_custkey AS customer, CAST(round(o_totalprice * 100) AS BIGINT) AS amount,
         epoch_us(o_orderdate) // 1000 AS stamp
  FROM orders
  UNION ALL
  SELECT CASE WHEN o_orderkey % 10 = 9 THEN 'INV-' ELSE 'BILL-' END || o_orderkey,
         epoch_us(o_orderdate) // 1000 + CAST(3888000000 AS BIGINT), 0, 1, 0, 0,
         'Bill', 'ORD-' || o_orderkey, 'CUST-' || o_custkey,
         CAST(round(o_totalprice * 100) AS BIGINT) + o_orderkey % 2, epoch_us(o_orderdate) // 1000
  FROM orders WHERE o_orderstatus = 'P'
  UNION ALL
  SELECT 'BILL-' || l_orderkey, epoch_us(l_shipdate) // 1000,
         CASE WHEN l_returnflag = 'R' THEN 2 ELSE 1 END, l_linenumber, l_partkey, l_suppkey,
         CASE WHEN l_returnflag = 'R' THEN 'PaymentFailed' ELSE 'PaymentRequest' END,
         'PAY-' || l_orderkey || '-' || l_linenumber,
         coalesce('CUST-' || o_custkey, 'unknown'),
         CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(round(l_extendedprice * 100) AS BIGINT) END,
         epoch_us(l_shipdate) // 1000
  FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
billing AS (
  SELECT *, row_number() OVER (PARTITION BY key ORDER BY happened, rank, line, part, supp) AS seq
  FROM unnumbered)"""

COUNTED = """
counted AS (
  SELECT name AS count_key, seq, kind, key FROM chasers
  UNION ALL
  SELECT CASE kind WHEN 'Bill' THEN 'Bill-' WHEN 'PaymentRequest' THEN 'PayReq-'
         ELSE 'PayFail-' END || key, seq, kind, key FROM billing)"""

CHASER_RECORDS = f"""
names AS (
  SELECT key, name, count(*) AS n, max(seq) AS last_seq, max(sent) AS sent, max(ttl) AS ttl
  FROM chasers GROUP BY key, name),
placed AS (
  SELECT *, (row_number() OVER (PARTITION BY key ORDER BY last_seq DESC) - 1) // {PAGE} AS page
  FROM names),
totals AS (
  SELECT key, CAST(1 + count(*) AS BIGINT) AS n, greatest(max(sent), 0) AS latest,
         greatest(max(ttl), 0) AS longest
  FROM chasers GROUP BY key),
records AS (
  SELECT p.key, p.page, string_agg(p.name, ',' ORDER BY p.last_seq DESC) AS names,
         any_value(t.n) AS event_count, any_value(t.latest) AS latest,
         any_value(t.longest) AS longest
  FROM placed p JOIN totals t ON p.key = t.key GROUP BY p.key, p.page)"""

# One row per event with what decides the state: payments so far, the bill before, and
# where the event stands among the failures since the last request.
BILLING_STEPS = """
steps AS (
  SELECT *,
         count(*) FILTER (WHERE kind = 'PaymentRequest')
           OVER (PARTITION BY key ORDER BY seq) AS stretch,
         lag(amount) OVER (PARTITION BY key, kind ORDER BY seq) AS amount_before,
         row_number() OVER (PARTITION BY key, kind, id ORDER BY seq) AS nth_of_id
  FROM billing),
judged AS (
  SELECT *,
         row_number() OVER (PARTITION BY key, stretch, kind ORDER BY seq) AS nth_of_kind,
         max(stretch) OVER (PARTITION BY key) AS last_stretch,
         (kind = 'PaymentRequest' AND nth_of_id = 1) AS added
  FROM steps),
events_judged AS (
  SELECT *,
         (kind = 'PaymentFailed' AND nth_of_kind >= 2)
           OR (kind = 'Bill' AND amount_before IS NOT NULL AND amount_before <> amount) AS error,
         CAST(count(*) FILTER (WHERE added) OVER (PARTITION BY key ORDER BY seq) AS BIGINT)
           AS payment_count
  FROM judged)"""

BILLING_RECORDS = f"""
states AS (
  SELECT key,
         arg_max(customer, seq) FILTER (WHERE kind = 'Bill') AS bill_customer_id,
         arg_max(amount, seq) FILTER (WHERE kind = 'Bill') AS bill_amount_cents,
         max(payment_count) AS payment_count,
         arg_min(id, seq) FILTER (WHERE kind = 'PaymentFailed' AND stretch = last_stretch)
           AS last_failed_payment_id,
         arg_min(stamp, seq) FILTER (WHERE kind = 'PaymentFailed' AND stretch = last_stretch)
           AS last_failed_at,
         bool_or(error) AS errored
  FROM events_judged GROUP BY key),
lists AS (
  SELECT key, (payment_count - 1) // {PAGE} AS page, string_agg(id, ',' ORDER BY seq) AS payment_ids
  FROM events_judged WHERE added GROUP BY ALL),
records AS (
  SELECT s.key, coalesce(l.page, 0) AS page, bill_customer_id,
         bill_amount_cents, coalesce(payment_ids, '') AS payment_ids, payment_count,
         last_failed_payment_id, last_failed_at, errored
  FROM states s LEFT JOIN lists l ON s.key = l.key)"""

# Every frame, and which ones arrive damaged.
DAMAGE = """CASE (seq + length(key)) % 20 WHEN 0 THEN 'null_value' WHEN 1 THEN 'too_short'
         WHEN 2 THEN 'bad_magic' WHEN 3 THEN 'unknown_schema' WHEN 4 THEN 'bad_body' END"""


def _with(*parts: str) -> str:
    return "WITH" + ",".join(parts)


def _events_of(*columns: str) -> str:
    chaser, billing = (", ".join(c) for c in zip(*[c.split("|") for c in columns]))
    return f"SELECT {chaser} FROM chasers UNION ALL SELECT {billing} FROM billing"


CHASER_RESULT = f"{_with(CHASERS, CHASER_RECORDS)} SELECT * FROM records"
BILLING_RESULT = f"{_with(BILLING, BILLING_STEPS, BILLING_RECORDS)} SELECT * FROM records"

FRESHNESS = """
beats AS (SELECT event_type AS source, epoch_us(ts) // 1000 AS happened FROM events),
span AS (SELECT min(happened) AS start, max(happened) AS stop FROM beats),
checks AS (
  SELECT source, max(happened) AS latest, max(happened) + 1800000 >= (SELECT stop FROM span) AS valid
  FROM beats GROUP BY source
  UNION ALL SELECT 'silent-old', start, start + 1800000 >= stop FROM span
  UNION ALL SELECT 'silent-new', stop, true FROM span
  UNION ALL SELECT 'silent-stale', stop - 1 - 1800000, stop - 1 >= stop FROM span)"""

ORACLE = {
    "event_counts": f"""{_with(CHASERS, BILLING, COUNTED)}
        SELECT count_key, count(*) AS n FROM counted GROUP BY count_key""",
    "event_count_changelog": f"""{_with(CHASERS, BILLING, COUNTED)}
        SELECT count_key, seq,
               row_number() OVER (PARTITION BY count_key ORDER BY seq, kind, key) AS n
        FROM counted""",
    "chaser_aggregate": CHASER_RESULT,
    "chaser_changelog": f"""{_with(CHASERS)}, flagged AS (
          SELECT *, row_number() OVER (PARTITION BY key, name ORDER BY seq) = 1 AS name_is_new
          FROM chasers)
        SELECT key, seq, name, name_is_new,
               CAST(count(*) FILTER (WHERE name_is_new) OVER w AS BIGINT) AS names_count,
               CAST(1 + count(*) OVER w AS BIGINT) AS event_count,
               greatest(max(sent) OVER w, 0) AS latest, greatest(max(ttl) OVER w, 0) AS longest
        FROM flagged WINDOW w AS (PARTITION BY key ORDER BY seq)""",
    "billing_aggregate": BILLING_RESULT,
    "billing_changelog": f"""{_with(BILLING, BILLING_STEPS)}
        SELECT key, seq, kind,
               last_value(CASE WHEN kind = 'Bill' THEN customer END IGNORE NULLS) OVER w
                 AS bill_customer_id,
               last_value(CASE WHEN kind = 'Bill' THEN amount END IGNORE NULLS) OVER w
                 AS bill_amount_cents,
               CASE WHEN added THEN id END AS added_payment_id, payment_count,
               first_value(CASE WHEN kind = 'PaymentFailed' THEN id END IGNORE NULLS) OVER s
                 AS last_failed_payment_id,
               first_value(CASE WHEN kind = 'PaymentFailed' THEN stamp END IGNORE NULLS) OVER s
                 AS last_failed_at,
               bool_or(error) OVER w AS errored
        FROM events_judged
        WINDOW w AS (PARTITION BY key ORDER BY seq),
               s AS (PARTITION BY key, stretch ORDER BY seq)""",
    "billing_customers": f"""{_with(BILLING)}
        SELECT customer AS customer_id, count(*) AS n_events FROM billing GROUP BY customer""",
    "processing_meters": f"""{_with(CHASERS, BILLING)}
        SELECT (SELECT count(*) FROM chasers) AS chaser_received,
               coalesce((SELECT arg_max(ttl, seq) FROM chasers), 0) AS chaser_ttl_value,
               (SELECT count(*) FROM billing) AS billing_aggregation,
               (SELECT count(DISTINCT key) FROM billing WHERE kind = 'Bill')
                 AS billing_customer_bills""",
    "chaser_lookup": f"{CHASER_RESULT} WHERE key = 'user-1'",
    "billing_lookup": f"{BILLING_RESULT} WHERE key = 'BILL-6'",
    "chaser_keys": f"{_with(CHASERS)} SELECT DISTINCT key FROM chasers",
    "billing_keys": f"{_with(BILLING)} SELECT DISTINCT key FROM billing",
    "aggregate_json": f"""{_with(BILLING, BILLING_STEPS, BILLING_RECORDS)}
        SELECT key, errored, payment_count, bill_amount_cents,
               last_failed_payment_id IS NULL AS no_failure
        FROM records""",
    "frame_roundtrip": f"""{_with(CHASERS)}
        SELECT key, seq, kind, name, sent, ttl, previous FROM chasers""",
    "billing_frame_roundtrip": f"""{_with(BILLING)}
        SELECT key, seq, kind, id, amount AS amount_cents, stamp FROM billing""",
    "frame_rejects": f"""{_with(CHASERS, BILLING)}
        SELECT key, seq, {DAMAGE} AS reject_reason,
               CASE WHEN (seq + length(key)) % 20 = 4 THEN kind END AS rejected_kind
        FROM ({_events_of("key|key", "seq|seq", "kind|kind")})
        WHERE (seq + length(key)) % 20 < 5""",
    "damaged_topic_billing": f"""{_with(BILLING.replace("billing AS (", "sent AS ("),
        " billing AS (SELECT * FROM sent WHERE (seq + length(key)) % 20 >= 5)",
        BILLING_STEPS, BILLING_RECORDS)} SELECT * FROM records""",
    "aggregate_frames_roundtrip": f"""{_with(CHASERS, CHASER_RECORDS.replace("records AS", "summaries AS"),
        BILLING, BILLING_STEPS, BILLING_RECORDS)}
        SELECT key, page, 'Aggregate' AS kind, names AS items, event_count AS n, latest, longest,
               NULL AS bill_amount_cents, NULL AS last_failed_at, NULL AS errored
        FROM summaries
        UNION ALL
        SELECT key, page, 'BillAggregate', payment_ids, NULL, NULL, NULL, bill_amount_cents,
               last_failed_at, errored
        FROM records""",
    "schema_usage": f"""{_with(CHASERS, BILLING)}, used AS (
          SELECT kind, count(*) AS n FROM ({_events_of("kind|kind")}) GROUP BY kind),
        known(kind, name, schema_id) AS (VALUES
          ('Chaser', 'events.chaser.Chaser', 1), ('Aggregate', 'events.chaser.Aggregate', 2),
          ('Bill', 'events.billing.Bill', 3),
          ('PaymentRequest', 'events.billing.PaymentRequest', 4),
          ('PaymentFailed', 'events.billing.PaymentFailed', 5),
          ('BillAggregate', 'events.billing.BillAggregate', 6))
        SELECT name AS full_name, 'input-' || name AS subject,
               CAST(schema_id AS BIGINT) AS schema_id, coalesce(n, 0) AS n_frames
        FROM known LEFT JOIN used ON known.kind = used.kind""",
    "json_envelope": f"""{_with(CHASERS, BILLING)}
        {_events_of("key|key", "seq|seq", "kind|kind", "id AS id_field|id",
                    "CAST(NULL AS BIGINT) AS amount_cents|amount")}""",
    "sql_text_rows": """
        SELECT o_orderstatus AS status, count(*) AS n, max(o_totalprice) AS largest
        FROM orders GROUP BY o_orderstatus""",
    "source_freshness": f"{_with(FRESHNESS)} SELECT * FROM checks",
    "freshness_rollup": f"""{_with(FRESHNESS)}
        SELECT bool_and(valid) AS valid, count(*) AS n_checks FROM checks""",
    "backlog_readiness": """WITH
        arrived AS (SELECT event_type AS instance, epoch_us(ts) // 1000 AS happened FROM events),
        ticks AS (SELECT instance, (happened - (SELECT min(happened) FROM arrived)) // 900000 AS tick
                  FROM arrived),
        grid AS (
          SELECT instance, unnest(range(0, (SELECT max(tick) + 1 FROM ticks))) AS tick
          FROM (SELECT DISTINCT instance FROM ticks)),
        filled AS (
          SELECT g.instance, g.tick, count(t.tick) AS n
          FROM grid g LEFT JOIN ticks t ON g.instance = t.instance AND g.tick = t.tick
          GROUP BY ALL),
        net AS (
          SELECT *, CAST(sum(n - 1) OVER (PARTITION BY instance ORDER BY tick) AS BIGINT) AS net
          FROM filled),
        held AS (
          SELECT *, net - least(0, min(net) OVER (PARTITION BY instance ORDER BY tick)) AS after
          FROM net),
        seen AS (
          SELECT instance, tick,
                 coalesce(lag(after) OVER (PARTITION BY instance ORDER BY tick), 0) + n AS backlog
          FROM held)
        SELECT instance, tick, backlog,
               coalesce(last_value(CASE WHEN backlog > 5 THEN false WHEN backlog = 0 THEN true END
                                   IGNORE NULLS) OVER (PARTITION BY instance ORDER BY tick),
                        false) AS ready
        FROM seen""",
    "streaming_event_counts": f"""{_with(CHASERS, BILLING, COUNTED)}
        SELECT count_key, count(*) AS n FROM counted GROUP BY count_key""",
    "streaming_chaser_aggregate": CHASER_RESULT,
    "streaming_billing_aggregate": BILLING_RESULT,
}
# Streams that keep state give what the batch operators give.
ORACLE |= {
    "streaming_event_count_changelog": ORACLE["event_count_changelog"],
    "streaming_chaser_changelog": ORACLE["chaser_changelog"],
    "streaming_billing_changelog": ORACLE["billing_changelog"],
    "kept_chaser_pages": CHASER_RESULT,
    "kept_billing_pages": BILLING_RESULT,
    "kept_billing_records": BILLING_RESULT,
    "kept_chaser_lookup": ORACLE["chaser_lookup"],
    "kept_billing_lookup": ORACLE["billing_lookup"],
    "kept_billing_keys": ORACLE["billing_keys"],
    "streaming_meters": ORACLE["processing_meters"],
}
