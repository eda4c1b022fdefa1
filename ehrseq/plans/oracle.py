"""The same results as plain SQL over the given tables, for comparison in another engine.

Written in the relational form of the definitions (self-joins, whole-group windows, minimum over
range joins), not in the form of the Spark jobs.
"""

SEED = 7
LENGTH = 32
TRAIN_FRACTION = 0.8

CDM = """
cdm_person AS (
  SELECT c_custkey AS person_id, 1930 + c_custkey % 70 AS year_of_birth, nullif(c_custkey % 13, 0) AS month_of_birth,
    nullif(c_custkey % 32, 0) AS day_of_birth,
    CASE WHEN c_custkey % 2 = 0 THEN 8507 ELSE 8532 END AS gender_concept_id
  FROM customer),
person_dob AS (
  SELECT person_id, CAST(make_date(CAST(year_of_birth AS INT), CAST(coalesce(month_of_birth, 1) AS INT), 1)
    + CAST(coalesce(day_of_birth, 1) - 1 AS INT) AS DATE) AS date_of_birth
  FROM cdm_person),
cdm_period AS (
  SELECT c_custkey AS person_id, c_custkey * 10 + k AS observation_period_id, CAST(s AS DATE) AS op_start,
    CAST(e AS DATE) AS op_end
  FROM customer, (VALUES (1, '1995-01-01', '1996-12-31'), (2, '1998-01-01', '2000-12-31')) AS spans(k, s, e)
  WHERE c_acctbal >= 0),
cdm_visit AS (
  SELECT o_custkey AS person_id, o_orderkey AS visit_occurrence_id, CAST(o_orderdate AS DATE) AS visit_start_date,
    CAST(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 * 7 AS INT) AS DATE) AS visit_end_date,
    CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 9203 WHEN o_orderpriority = '3-MEDIUM' THEN 9202
      ELSE 9201 END AS visit_concept_id
  FROM orders WHERE o_orderpriority <> '5-LOW'),
event_base AS (
  SELECT o_custkey AS person_id, CAST(l_shipdate AS DATE) AS start_date,
    CASE WHEN l_linenumber IN (1, 4, 7) THEN l_orderkey END AS visit_occurrence_id,
    CASE WHEN l_discount = 0 THEN 0 ELSE 1000000 + l_partkey % 100 END AS concept_id,
    2000000 + l_partkey AS drug_id, l_returnflag, l_linestatus
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN (VALUES (1), (2)) AS copies(copy) ON copy = 1 OR l_quantity > 47),
cdm_drug AS (
  SELECT person_id, start_date, drug_id, visit_occurrence_id FROM event_base WHERE l_returnflag = 'R'),
cdm_death AS (
  SELECT c_custkey AS person_id, CAST(DATE '2000-06-15' + CAST(c_custkey % 100 AS INT) AS DATE) AS death_date
  FROM customer WHERE c_acctbal > 9600),
cdm_concept AS (
  SELECT DISTINCT 3000000 + CAST(split_part(p_brand, '#', 2) AS BIGINT) AS concept_id, 'Ingredient' AS concept_class_id
  FROM part UNION ALL SELECT 2000000 + p_partkey, 'Clinical Drug' FROM part),
cdm_ancestor AS (
  SELECT 3000000 + CAST(split_part(p_brand, '#', 2) AS BIGINT) AS ancestor_concept_id,
    2000000 + p_partkey AS descendant_concept_id FROM part WHERE p_size < 50
  UNION ALL SELECT 3000000 + CAST(split_part(p_brand, '#', 2) AS BIGINT) % 25 + 1, 2000000 + p_partkey
  FROM part WHERE p_size <= 5
  UNION ALL SELECT 2000000 + p_partkey, 2000000 + p_partkey FROM part),
cdm_label AS (
  SELECT c_custkey AS person_id, c_acctbal > 5000 AS label FROM customer WHERE c_mktsegment <> 'MACHINERY'),
mapping AS (
  SELECT descendant_concept_id AS source_concept_id, ancestor_concept_id AS target_concept_id
  FROM cdm_ancestor JOIN cdm_concept ON ancestor_concept_id = concept_id
  WHERE concept_class_id = 'Ingredient')"""

EVENTS = (
    CDM
    + """,
mapped_drug AS (
  SELECT person_id, start_date, target_concept_id AS concept_id, visit_occurrence_id
  FROM cdm_drug JOIN mapping ON drug_id = source_concept_id),
event_union AS (
  SELECT person_id, death_date AS start_date, 4306655 AS concept_id, CAST(NULL AS BIGINT) AS visit_occurrence_id
  FROM cdm_death
  UNION ALL SELECT person_id, start_date, concept_id, visit_occurrence_id FROM mapped_drug
  UNION ALL SELECT person_id, start_date, concept_id, visit_occurrence_id FROM event_base
  WHERE l_returnflag IN ('A', 'N')),
event_kept AS (SELECT * FROM event_union WHERE concept_id IS NULL OR concept_id <> 0),
event_distinct AS (SELECT DISTINCT * FROM event_kept)"""
)

# Days count from 1970; the visits of a day are numbered from 1, and a visit made for a day has number 0.
LINK = (
    EVENTS
    + """,
stay AS MATERIALIZED (
  SELECT person_id, visit_occurrence_id, visit_start_date AS first_day, visit_end_date AS last_day, visit_concept_id,
    epoch(visit_start_date)::BIGINT // 86400 * 4294967296
      + row_number() OVER (PARTITION BY person_id, visit_start_date ORDER BY visit_end_date, visit_occurrence_id) AS place
  FROM cdm_visit),
named AS MATERIALIZED (
  SELECT e.*, s.place AS named_place, s.person_id AS named_person
  FROM event_distinct e LEFT JOIN stay s USING (visit_occurrence_id)),
event_day AS MATERIALIZED (
  SELECT person_id, start_date, (SELECT min(place) FROM stay s
      WHERE s.person_id = n.person_id AND n.start_date BETWEEN s.first_day AND s.last_day) AS covering_place,
    bool_or(named_place IS NULL) AS someone_unnamed
  FROM named n GROUP BY person_id, start_date),
routed AS MATERIALIZED (
  SELECT DISTINCT n.person_id, n.start_date, concept_id, named_place, named_person, covering_place,
    someone_unnamed AND covering_place IS NULL AS new_day,
    CASE WHEN named_place IS NOT NULL THEN 'name' WHEN covering_place IS NOT NULL THEN 'day' ELSE 'none' END AS route
  FROM named n JOIN event_day USING (person_id, start_date)),
made AS MATERIALIZED (
  SELECT person_id, start_date, epoch(start_date)::BIGINT // 86400 * 4294967296 AS place
  FROM event_day WHERE someone_unnamed AND covering_place IS NULL),
housed AS MATERIALIZED (
  SELECT person_id, concept_id, start_date, coalesce(named_person, person_id) AS house_person,
    CASE route WHEN 'name' THEN named_place WHEN 'day' THEN covering_place
      ELSE epoch(start_date)::BIGINT // 86400 * 4294967296 END AS place
  FROM routed),
house AS MATERIALIZED (
  SELECT person_id, first_day, last_day, visit_concept_id, place FROM stay
  UNION ALL SELECT person_id, start_date, start_date, 1, place FROM made),
route_count AS (
  SELECT count(*) FILTER (route = 'name') AS mapped_by_id, count(*) FILTER (route = 'day') AS mapped_by_date,
    count(*) FILTER (new_day) AS mapped_to_new_visit, count(*) FILTER (route = 'none') AS used_new_visit,
    (SELECT count(*) FROM made) AS new_visits, (SELECT count(*) FROM stay) AS existing_visits
  FROM routed)"""
)

TOKENS = (
    LINK
    + """,
placed AS MATERIALIZED (
  SELECT h.*, observation_period_id, date_of_birth, row_number() OVER line AS turn, lag(last_day) OVER line AS left_on
  FROM house h JOIN cdm_period p ON h.person_id = p.person_id AND first_day BETWEEN op_start AND op_end
    JOIN person_dob d ON d.person_id = h.person_id
  WINDOW line AS (PARTITION BY observation_period_id ORDER BY place)),
mark AS (
  SELECT p.*, unnest([
      {'word': CASE WHEN first_day < left_on THEN 'W-1' WHEN first_day - left_on < 28 THEN 'W' || ((first_day - left_on) // 7)
          WHEN first_day - left_on < 360 THEN 'M' || ((first_day - left_on) // 30) ELSE 'LT' END,
        'on_day': first_day, 'rank': -2::BIGINT},
      {'word': 'VS', 'on_day': first_day, 'rank': -1::BIGINT},
      {'word': 'VE', 'on_day': last_day, 'rank': 9223372036854775807::BIGINT}], recursive := true)
  FROM placed p
  UNION ALL
  SELECT p.*, CAST(e.concept_id AS VARCHAR), e.start_date, e.concept_id
  FROM housed e JOIN placed p ON p.person_id = e.house_person AND p.place = e.place),
all_token AS MATERIALIZED (
  SELECT person_id, observation_period_id, word AS concept_ids, rank AS sort_order, on_day AS token_date, turn AS visit_concept_orders,
    CASE WHEN rank = -2 THEN 0 ELSE 1 + turn % 2 END AS visit_segments,
    CASE WHEN rank = -2 THEN 0 ELSE epoch(on_day)::BIGINT // 604800 END AS dates,
    CASE WHEN rank = -2 THEN -1 ELSE date_diff('month', date_of_birth, on_day) END AS ages,
    CASE WHEN rank = -2 THEN '0' ELSE CAST(visit_concept_id AS VARCHAR) END AS visit_concept_ids
  FROM mark WHERE rank IS DISTINCT FROM -2 OR turn > 1),
token AS (
  SELECT *, row_number() OVER (PARTITION BY observation_period_id
    ORDER BY visit_concept_orders, sort_order NULLS LAST, token_date) - 1 AS orders FROM all_token),
labelled_token AS (
  SELECT t.*, label, row_number() OVER (PARTITION BY observation_period_id
    ORDER BY visit_concept_orders, sort_order NULLS LAST, token_date) - 1 AS orders
  FROM all_token t JOIN cdm_label l ON t.person_id = l.person_id)"""
)


def draw(stream, *keys):
    text = ", ".join([f"'{SEED}'", *keys, f"'{stream}'"])
    return f"(CAST('0x' || substr(md5(concat_ws('|', {text})), 1, 8) AS BIGINT) / 4294967296.0)"


PERIOD = ("person_id", "observation_period_id")

VOCABULARY = (
    TOKENS
    + f""",
training AS (SELECT * FROM token WHERE {draw('split', 'person_id')} < {TRAIN_FRACTION}),
special AS (SELECT * FROM (VALUES ('[PAD]', 0), ('[MASK]', 1), ('[OOV]', 2), ('[CLS]', 3)) AS s(token, token_id)),
vocab AS (
  SELECT token, token_id FROM special UNION ALL
  SELECT token, row_number() OVER (ORDER BY token) + 3 FROM (SELECT DISTINCT concept_ids AS token FROM training)),
visit_vocab AS (
  SELECT token, token_id FROM special UNION ALL
  SELECT token, row_number() OVER (ORDER BY token) + 3
  FROM (SELECT DISTINCT visit_concept_ids AS token FROM training)),
encoded AS (
  SELECT t.*, coalesce(v.token_id, 2) AS token_id, coalesce(w.token_id, 2) AS visit_token_id,
    count(*) OVER (PARTITION BY observation_period_id) AS n,
    max(visit_concept_orders) OVER (PARTITION BY observation_period_id) AS last_visit
  FROM token t LEFT JOIN vocab v ON t.concept_ids = v.token
  LEFT JOIN visit_vocab w ON t.visit_concept_ids = w.token)"""
)

ROOM = LENGTH - 1
TAIL = f"orders >= greatest(0, n - {ROOM}) AND orders < n"


def frame(name, begin, end, extra=""):
    """Tokens of each sequence between two positions."""
    return f""",
{name} AS (SELECT * FROM (SELECT *, {begin} AS lo, {end} AS hi FROM encoded {extra})
  WHERE orders >= lo AND orders < hi)"""


TAIL_FRAME = frame("kept", f"greatest(0, n - {ROOM})", "n")
RANDOM_FRAME = frame(
    "kept",
    f"CASE WHEN n > {ROOM} THEN CAST(floor({draw('truncate', *PERIOD)} * (n - {ROOM} + 1)) AS BIGINT) ELSE 0 END",
    f"CASE WHEN n > {ROOM} THEN least(n, CAST(floor({draw('truncate', *PERIOD)} * (n - {ROOM} + 1)) AS BIGINT) + {ROOM}) ELSE n END",
)
NEXT_VISIT_END = f""",
last_start AS (
  SELECT observation_period_id, max(orders) FILTER (WHERE visit_concept_orders = last_visit - 1) AS stop,
    max(last_visit) AS last_visit
  FROM encoded GROUP BY observation_period_id
  HAVING max(orders) FILTER (WHERE visit_concept_orders = last_visit - 1) IS NOT NULL),
kept AS (
  SELECT e.* FROM encoded e JOIN last_start s ON e.observation_period_id = s.observation_period_id
  WHERE orders >= greatest(0, stop - {ROOM}) AND orders < stop)"""


def listed(expression):
    return f"string_agg(CAST({expression} AS VARCHAR), ',' ORDER BY orders)"


def padded(expression, prefix, padding):
    return (
        f"'{prefix}' || ',' || {listed(expression)} || "
        f"CASE WHEN count(*) < {ROOM} THEN repeat(',{padding}', CAST({ROOM} - count(*) AS INT)) ELSE '' END"
    )


def per_period(columns, source="kept"):
    return f"SELECT person_id, observation_period_id, {columns} FROM {source} GROUP BY ALL"


SEQUENCE_LISTS = ", ".join(
    f"{listed(c)} AS {c}"
    for c in (
        "concept_ids",
        "visit_segments",
        "dates",
        "ages",
        "visit_concept_orders",
        "visit_concept_ids",
        "orders",
    )
)
TOKEN_LIST = """person_id, observation_period_id, concept_ids, visit_segments, dates, ages, visit_concept_orders,
  visit_concept_ids, sort_order"""

INPUTS = ", ".join(
    [
        f"{padded('token_id', 3, 0)} AS token_ids",
        f"{padded('visit_token_id', 3, 0)} AS visit_token_ids",
        f"{padded('visit_segments', 0, 0)} AS visit_segments",
        f"{padded('visit_concept_orders - smallest + 1', 0, LENGTH - 1)} AS visit_concept_orders",
        f"{padded('ages', 0, 0)} AS ages",
        f"{padded('dates', 0, 0)} AS dates",
        "count(*) + 1 AS unpadded",
    ]
)
RELATIVE = "(SELECT *, min(visit_concept_orders) OVER (PARTITION BY observation_period_id) AS smallest FROM kept)"

POSITION = (*PERIOD, "orders")
MASKED = f"""CASE WHEN NOT chosen THEN token_id WHEN {draw('dice', *POSITION)} < 0.8 THEN 1
  WHEN {draw('dice', *POSITION)} < 0.9 THEN 4 + CAST(floor({draw('word', *POSITION)}
    * ((SELECT max(token_id) FROM vocab) - 4 + 1)) AS BIGINT) ELSE token_id END"""
ALL_CHOSEN = f"(SELECT *, {draw('mask', *POSITION)} < 0.15 AS chosen FROM kept)"
ONE_CHOSEN = f"""(SELECT *, coalesce(orders = min(orders) FILTER (WHERE {draw('mask', *POSITION)} < 0.15)
    OVER (PARTITION BY observation_period_id, visit_concept_orders), FALSE) AS chosen
  FROM kept)"""


def mask_columns(value, chosen):
    return f"{padded(value, 3, 0)} AS shown, {padded(f'CASE WHEN {chosen} THEN 0 ELSE 1 END', 1, 1)} AS unmasked"


PREDICTIONS = """
prediction AS (
  SELECT l_returnflag AS pretrained_model, l_linestatus AS fine_tuned_model,
    l_extendedprice / (l_extendedprice + 50000.0) AS p, CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END AS y
  FROM lineitem),
by_score AS (
  SELECT pretrained_model, fine_tuned_model, p, sum(y) AS pos, sum(1 - y) AS neg FROM prediction GROUP BY ALL),
running AS (
  SELECT *, coalesce(sum(neg) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below,
    sum(pos) OVER (d ROWS UNBOUNDED PRECEDING) AS pos_above,
    sum(neg) OVER (d ROWS UNBOUNDED PRECEDING) AS neg_above,
    sum(pos) OVER (PARTITION BY pretrained_model, fine_tuned_model) AS all_pos,
    sum(neg) OVER (PARTITION BY pretrained_model, fine_tuned_model) AS all_neg
  FROM by_score
  WINDOW w AS (PARTITION BY pretrained_model, fine_tuned_model ORDER BY p),
    d AS (PARTITION BY pretrained_model, fine_tuned_model ORDER BY p DESC)),
ranking AS (
  SELECT pretrained_model, fine_tuned_model,
    CAST(sum(pos * (2 * neg_below + neg)) AS DOUBLE) / 2 / (CAST(max(all_pos) AS DOUBLE) * max(all_neg)) AS auc,
    sum(pos / all_pos * pos_above / (pos_above + neg_above)) AS auprc
  FROM running GROUP BY ALL),
mean_metric AS (
  SELECT pretrained_model, fine_tuned_model, avg((p - y) * (p - y)) AS brier,
    avg(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100))) AS mean_loss
  FROM prediction GROUP BY ALL)"""
CELL = "pretrained_model, fine_tuned_model"
EPOCHS = PREDICTIONS.replace(
    "l_linestatus AS fine_tuned_model", "l_linenumber % 3 AS epoch, CAST(l_orderkey % 5 <> 0 AS INT) AS is_train"
).replace("fine_tuned_model", "epoch, is_train")
EPOCH_CELL = "pretrained_model, epoch, is_train"

# Steps of the gradient fit that are compared.
ADAM_STEPS = 4


def adam_steps(rate, decay):
    """A chain of steps, each from the weights of the one before."""
    ctes = f"""
present AS MATERIALIZED (
  SELECT person_id, observation_period_id, token_id, CAST(label AS DOUBLE) AS y FROM (
    SELECT DISTINCT person_id, observation_period_id, token_id FROM kept
    UNION SELECT DISTINCT person_id, observation_period_id, 3 FROM kept
    UNION SELECT DISTINCT person_id, observation_period_id, -1 FROM kept
    UNION SELECT person_id, observation_period_id, 0 FROM kept GROUP BY ALL HAVING count(*) < {ROOM})
  JOIN cdm_label USING (person_id) WHERE {draw('split', 'person_id')} < {TRAIN_FRACTION}),
w0 AS MATERIALIZED (
  SELECT token_id, 0.0::DOUBLE AS w, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM (SELECT token_id FROM vocab UNION ALL SELECT -1))"""
    for n in range(1, ADAM_STEPS + 1):
        ctes += f""",
margin{n} AS MATERIALIZED (
  SELECT person_id, observation_period_id, sum(w) AS z FROM present JOIN w{n - 1} USING (token_id) GROUP BY ALL),
slope{n} AS MATERIALIZED (
  SELECT token_id, sum(1 / (1 + exp(-z)) - y) / (SELECT count(*) FROM margin{n}) AS g
  FROM present JOIN margin{n} USING (person_id, observation_period_id) GROUP BY token_id),
moment{n} AS MATERIALIZED (
  SELECT token_id, w, 0.9 * m + 0.1 * (coalesce(g, 0) + {decay} * w) AS m, 0.999 * v + 0.001 * pow(coalesce(g, 0) + {decay} * w, 2) AS v
  FROM w{n - 1} LEFT JOIN slope{n} USING (token_id)),
w{n} AS MATERIALIZED (
  SELECT token_id, w - {rate} * (m / (1 - pow(0.9, {n}))) / (sqrt(v / (1 - pow(0.999, {n}))) + 1e-8) AS w, m, v FROM moment{n})"""
    return ctes


LOGITS = """
cell AS (
  SELECT vec_id, label AS target, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings),
softmax AS (
  SELECT vec_id, max(target) AS target, ln(sum(exp(x))) - sum(CASE WHEN i = target THEN x END) AS loss,
    CASE WHEN arg_max(i, x) = max(target) THEN 1.0 ELSE 0.0 END AS hit, max(CASE WHEN i = 0 THEN x END) > 0 AS ignored
  FROM cell GROUP BY vec_id),
multi AS (
  SELECT x, CASE WHEN i % 10 = target THEN 1 ELSE 0 END AS y FROM cell)"""
TOKEN_LOSS = "avg(loss) AS mean_loss, avg(hit) AS mean_accuracy"
MULTI_LOSS = """avg(greatest(x, 0) - x * y + ln(1 + exp(-abs(x)))) AS mean_loss,
  avg(CASE WHEN (x > 0) = (y = 1) THEN 1.0 ELSE 0.0 END) AS mean_accuracy"""

GRID = """
pretrained AS (
  SELECT o_orderpriority AS pretrained_model, count(DISTINCT year(o_orderdate)) AS num_epochs FROM orders GROUP BY 1),
fine_tuned AS (
  SELECT DISTINCT 'status ' || o_orderstatus AS fine_tuned_model, o_orderpriority AS pretrained_model,
    CASE WHEN o_orderstatus = 'F' THEN 2 END AS pretrained_epoch FROM orders),
grid AS (
  SELECT fine_tuned_model, pretrained_model, coalesce(pretrained_epoch, num_epochs) AS pretrained_epoch, train_label,
    test_label
  FROM fine_tuned JOIN pretrained USING (pretrained_model),
    (VALUES ('train A', 'A'), ('train N', 'N'), ('train R', 'R')) AS pairs(train_label, test_label)),
cell_metric AS (
  SELECT 'status ' || o_orderstatus AS fine_tuned_model, o_orderpriority AS pretrained_model,
    l_returnflag AS test_label, avg((p - y) * (p - y)) AS brier,
    avg(-(y * greatest(ln(p), -100) + (1 - y) * greatest(ln(1 - p), -100))) AS mean_loss
  FROM (SELECT *, l_extendedprice / (l_extendedprice + 50000.0) AS p, CASE WHEN l_tax >= 0.05 THEN 1 ELSE 0 END AS y
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
  GROUP BY 1, 2, 3),
combined AS (
  SELECT fine_tuned_model, pretrained_model, pretrained_epoch, test_label, brier, mean_loss
  FROM grid JOIN cell_metric USING (fine_tuned_model, pretrained_model, test_label))"""
NAME = "regexp_replace(pretrained_model, '[^A-Za-z0-9]', '', 'g') || '_e' || CAST(pretrained_epoch AS VARCHAR)"
SETTING = "regexp_replace(fine_tuned_model, '[^A-Za-z0-9]', '', 'g')"

COHORT = (
    LINK
    + """,
ordered_concept AS (
  SELECT concept_id, row_number() OVER (ORDER BY concept_id) - 1 AS place
  FROM (SELECT DISTINCT concept_id FROM event_distinct)),
chosen AS (
  SELECT concept_id FROM ordered_concept WHERE place IN (
    SELECT CAST(round_even(k * ((SELECT max(place) FROM ordered_concept) / 9.0), 0) AS BIGINT) FROM range(10) AS g(k))),
window_label AS (
  SELECT p.person_id, p.observation_period_id, c.concept_id, max(CASE WHEN e.concept_id IS NULL THEN 0 ELSE 1 END) AS label
  FROM cdm_period p CROSS JOIN chosen c LEFT JOIN event_distinct e ON e.person_id = p.person_id
    AND e.concept_id = c.concept_id AND e.start_date > p.op_end - 180 AND e.start_date <= p.op_end
    AND e.start_date >= p.op_start
  GROUP BY 1, 2, 3)"""
)

WEIGHT = "(token_id % 17 - 8) / 10.0"

# CTEs and the final select of each query.
_PARTS = {
    "cdm_scan": (
        CDM,
        """SELECT 'person' AS table_name, count(*) AS n FROM cdm_person
  UNION ALL SELECT 'observation_period', count(*) FROM cdm_period
  UNION ALL SELECT 'visit_occurrence', count(*) FROM cdm_visit
  UNION ALL SELECT 'condition_occurrence', count(*) FROM event_base WHERE l_returnflag = 'A'
  UNION ALL SELECT 'drug_exposure', count(*) FROM cdm_drug
  UNION ALL SELECT 'measurement', count(*) FROM event_base WHERE l_returnflag = 'N' AND l_linestatus = 'F'
  UNION ALL SELECT 'procedure_occurrence', count(*) FROM event_base WHERE l_returnflag = 'N' AND l_linestatus = 'O'
  UNION ALL SELECT 'death', count(*) FROM cdm_death
  UNION ALL SELECT 'concept', count(*) FROM cdm_concept
  UNION ALL SELECT 'concept_ancestor', count(*) FROM cdm_ancestor""",
    ),
    "label_scan": (CDM, "SELECT person_id, CAST(label AS INT) AS label FROM cdm_label"),
    "date_of_birth": (CDM, "SELECT person_id, CAST(date_of_birth AS VARCHAR) AS date_of_birth FROM person_dob"),
    "gender_concept": (CDM, "SELECT gender_concept_id, count(*) AS n FROM cdm_person GROUP BY 1"),
    "concept_ingredients": (CDM, "SELECT concept_id FROM cdm_concept WHERE concept_class_id = 'Ingredient'"),
    "ingredient_mapping": (CDM, "SELECT * FROM mapping"),
    "drug_to_ingredient": (
        EVENTS,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS drug_exposure_start_date, visit_occurrence_id, "
        "concept_id AS drug_concept_id FROM mapped_drug",
    ),
    "union_domains": (
        EVENTS,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS start_date, concept_id, visit_occurrence_id FROM event_union",
    ),
    "remove_concepts": (
        EVENTS,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS start_date, concept_id, visit_occurrence_id FROM event_kept",
    ),
    "removed_concepts": (
        EVENTS,
        "SELECT (SELECT count(*) FROM event_union) - (SELECT count(*) FROM event_kept) AS removed_concepts",
    ),
    "remove_duplicates": (
        EVENTS,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS start_date, concept_id, visit_occurrence_id "
        "FROM event_distinct",
    ),
    "link_by_id": (
        LINK,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS start_date, concept_id, visit_occurrence_id, "
        "named_place AS id_from_id, named_person AS visit_person_id FROM named",
    ),
    "link_by_date": (
        LINK,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS start_date, concept_id, named_place AS id_from_id, "
        "named_person AS visit_person_id, covering_place AS id_from_date FROM routed",
    ),
    "new_visits": (
        LINK,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS visit_start_date, CAST(start_date AS VARCHAR) AS "
        "visit_end_date, 1 AS visit_concept_id, place AS visit_seq FROM made",
    ),
    "link_events": (
        LINK,
        "SELECT person_id, concept_id, CAST(start_date AS VARCHAR) AS start_date, house_person AS visit_person_id, "
        "place AS visit_seq FROM housed",
    ),
    "all_visits": (
        LINK,
        "SELECT person_id, CAST(first_day AS VARCHAR) AS visit_start_date, CAST(last_day AS VARCHAR) AS "
        "visit_end_date, visit_concept_id, place AS visit_seq FROM house",
    ),
    "visit_numbers": (
        LINK,
        "SELECT person_id, visit_occurrence_id, row_number() OVER (PARTITION BY person_id ORDER BY visit_start_date, "
        "visit_end_date, visit_occurrence_id) AS visit_number FROM cdm_visit",
    ),
    "link_statistics": (LINK, "SELECT * FROM route_count"),
    "visits_in_period": (
        TOKENS,
        "SELECT person_id, observation_period_id, place AS visit_seq, turn AS visit_rank, "
        "CAST(left_on AS VARCHAR) AS previous_end FROM placed",
    ),
    "interval_token_rows": (TOKENS, f"SELECT {TOKEN_LIST} FROM all_token WHERE sort_order = -2"),
    "visit_token_rows": (TOKENS, f"SELECT {TOKEN_LIST} FROM all_token WHERE sort_order IN (-1, 9223372036854775807)"),
    "event_token_rows": (
        TOKENS,
        f"SELECT {TOKEN_LIST} FROM all_token WHERE sort_order IS NULL OR sort_order BETWEEN 0 AND 9223372036854775806",
    ),
    "token_stream": (
        TOKENS,
        f"""SELECT {TOKEN_LIST}, orders, count(concept_ids) OVER p AS sequence_length,
  max(visit_concept_orders) OVER p AS num_of_visits,
  min(orders) FILTER (WHERE visit_concept_orders = last_visit) OVER p AS last_visit_start
  FROM (SELECT *, max(visit_concept_orders) OVER (PARTITION BY observation_period_id) AS last_visit FROM token)
  WINDOW p AS (PARTITION BY observation_period_id)""",
    ),
    "sequences": (
        TOKENS,
        per_period(
            f"{SEQUENCE_LISTS}, count(concept_ids) AS num_of_concepts, max(visit_concept_orders) AS num_of_visits, "
            "list_position(list(visit_concept_orders ORDER BY orders), max(visit_concept_orders)) - 1 AS last_visit_start, "
            "0 AS part",
            "token",
        ),
    ),
    "labelled_sequences": (
        TOKENS,
        per_period(
            f"{SEQUENCE_LISTS}, count(concept_ids) AS num_of_concepts, max(visit_concept_orders) AS num_of_visits, "
            "list_position(list(visit_concept_orders ORDER BY orders), max(visit_concept_orders)) - 1 AS last_visit_start, "
            "0 AS part, CAST(bool_or(label) AS INT) AS label",
            "labelled_token",
        ),
    ),
    "pipeline_counters": (
        LINK,
        """SELECT (SELECT count(*) FROM cdm_person) AS persons, (SELECT count(*) FROM cdm_period) AS observation_periods,
  (SELECT count(*) FROM event_union) - (SELECT count(*) FROM event_kept) AS removed_concepts,
  (SELECT count(*) FROM event_kept) - (SELECT count(*) FROM event_distinct) AS removed_duplicates, *
  FROM route_count""",
    ),
    "train_test_split": (
        TOKENS,
        f"SELECT person_id, CASE WHEN {draw('split', 'person_id')} < {TRAIN_FRACTION} THEN 'train' ELSE 'test' END "
        "AS side, count(*) AS n FROM token GROUP BY ALL",
    ),
    "concept_vocabulary": (VOCABULARY, "SELECT token, token_id FROM vocab"),
    "visit_vocabulary": (VOCABULARY, "SELECT token, token_id FROM visit_vocab"),
    "vocabulary_facts": (
        VOCABULARY,
        "SELECT count(*) AS vocabulary_size, 0 AS padding_id, 1 AS mask_id, 2 AS out_of_vocabulary_id, "
        "3 AS classification_id, 4 AS first_token_id, count(*) - 1 AS last_token_id FROM vocab",
    ),
    "encode": (VOCABULARY, per_period(f"{listed('token_id')} AS token_ids", "encoded")),
    "decode": (
        VOCABULARY,
        per_period(
            f"{listed('word')} AS concept_ids",
            "(SELECT person_id, observation_period_id, orders, CASE WHEN token_id = 2 THEN '[OOV]' ELSE concept_ids "
            "END AS word FROM encoded)",
        ),
    ),
    "vocabulary_listing": (TOKENS, "SELECT DISTINCT concept_ids AS token FROM token"),
    "truncate_tail": (VOCABULARY + TAIL_FRAME, per_period(f"min(orders) AS first, max(orders) AS last, {listed('token_id')} AS token_ids")),
    "truncate_random": (
        VOCABULARY + RANDOM_FRAME,
        per_period(f"min(orders) AS first, max(orders) AS last, {listed('token_id')} AS token_ids"),
    ),
    "truncate_next_visit": (
        VOCABULARY + NEXT_VISIT_END,
        per_period(f"min(orders) AS first, max(orders) AS last, {listed('token_id')} AS token_ids"),
    ),
    "model_inputs": (VOCABULARY + TAIL_FRAME, per_period(INPUTS, RELATIVE)),
    "examples_from_sequences": (VOCABULARY + TAIL_FRAME, per_period(INPUTS, RELATIVE)),
    "evaluation_inputs": (VOCABULARY + TAIL_FRAME, per_period(INPUTS, RELATIVE)),
    "mask_concepts": (VOCABULARY + TAIL_FRAME, per_period(mask_columns(MASKED, "chosen"), ALL_CHOSEN)),
    "mask_one_per_visit": (
        VOCABULARY + TAIL_FRAME,
        per_period(mask_columns(MASKED, "chosen"), ONE_CHOSEN),
    ),
    "mask_visits": (
        VOCABULARY + TAIL_FRAME,
        per_period(
            mask_columns("CASE WHEN chosen THEN 1 ELSE visit_token_id END", "chosen"),
            f"(SELECT *, {draw('mask visit', *POSITION)} < 0.5 AS chosen FROM kept)",
        ),
    ),
    "next_token": (
        VOCABULARY
        + frame("kept", f"greatest(0, n - 1 - {ROOM})", "n - 1")
        + frame("following", f"greatest(0, n - 1 - {ROOM}) + 1", "n"),
        f"SELECT * FROM ({per_period(padded('token_id', 3, 0) + ' AS token_ids')}) JOIN "
        f"({per_period(padded('token_id', 3, 0) + ' AS next_token_ids', 'following')}) "
        "USING (person_id, observation_period_id)",
    ),
    "next_visit_set": (
        VOCABULARY + NEXT_VISIT_END,
        """SELECT person_id, observation_period_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY token_id)
    AS next_visit_token_set
  FROM (SELECT DISTINCT e.person_id, e.observation_period_id, token_id FROM encoded e JOIN last_start s
    ON e.observation_period_id = s.observation_period_id AND e.visit_concept_orders = s.last_visit)
  GROUP BY ALL""",
    ),
    "next_visit_dense": (
        VOCABULARY
        + NEXT_VISIT_END
        + """,
next_token AS (
  SELECT DISTINCT e.person_id, e.observation_period_id, token_id FROM encoded e JOIN last_start s
    ON e.observation_period_id = s.observation_period_id AND e.visit_concept_orders = s.last_visit)""",
        """SELECT p.person_id, p.observation_period_id,
    string_agg(CASE WHEN t.token_id IS NULL THEN '0' ELSE '1' END, ',' ORDER BY v.token_id) AS next_visit_token_set
  FROM (SELECT DISTINCT person_id, observation_period_id FROM next_token) p CROSS JOIN vocab v
    LEFT JOIN next_token t ON t.observation_period_id = p.observation_period_id AND t.token_id = v.token_id
  GROUP BY ALL""",
    ),
    "label_output": (
        TOKENS,
        per_period("CAST(bool_or(label) AS DOUBLE) AS finetune_label", "labelled_token"),
    ),
    "training_cap": (
        VOCABULARY,
        f"SELECT person_id, observation_period_id FROM (SELECT DISTINCT person_id, observation_period_id FROM labelled_token "
        f"WHERE {draw('split', 'person_id')} < {TRAIN_FRACTION}) "
        f"ORDER BY {draw('cap', *PERIOD)}, person_id, observation_period_id LIMIT 200",
    ),
    "baseline_fit": (TOKENS, "SELECT DISTINCT person_id, observation_period_id, 1 AS same FROM labelled_token"),
    "processed_sequences": (
        TOKENS,
        per_period(
            f"{SEQUENCE_LISTS}, count(concept_ids) AS num_of_concepts, max(visit_concept_orders) AS num_of_visits",
            "token",
        ),
    ),
    "token_presence": (
        VOCABULARY + TAIL_FRAME,
        f"""SELECT person_id, observation_period_id, string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY token_id) AS present
  FROM (SELECT DISTINCT person_id, observation_period_id, token_id FROM kept
    UNION SELECT DISTINCT person_id, observation_period_id, 3 FROM kept
    UNION SELECT person_id, observation_period_id, 0 FROM kept GROUP BY ALL HAVING count(*) < {ROOM})
  GROUP BY ALL""",
    ),
    "baseline_scores": (
        VOCABULARY + TAIL_FRAME,
        f"""SELECT person_id, observation_period_id, round(1 / (1 + exp(-(sum({WEIGHT}) + 0.25))), 6) AS prediction
  FROM (SELECT DISTINCT person_id, observation_period_id, token_id FROM kept
    UNION SELECT DISTINCT person_id, observation_period_id, 3 FROM kept
    UNION SELECT person_id, observation_period_id, 0 FROM kept GROUP BY ALL HAVING count(*) < {ROOM})
  GROUP BY ALL""",
    ),
    "baseline_gradient_fit": (
        VOCABULARY + TAIL_FRAME + "," + adam_steps(0.05, 0.01),
        f"SELECT token_id, round(w, 6) AS weight FROM w{ADAM_STEPS}",
    ),
    "presence_vectors": (
        VOCABULARY + TAIL_FRAME,
        f"""SELECT person_id, observation_period_id, (SELECT count(*) FROM vocab) AS size,
    string_agg(CAST(token_id AS VARCHAR), ',' ORDER BY token_id) AS places, CAST(any_value(label) AS DOUBLE) AS finetune_label
  FROM (SELECT DISTINCT person_id, observation_period_id, token_id FROM kept
    UNION SELECT DISTINCT person_id, observation_period_id, 3 FROM kept
    UNION SELECT person_id, observation_period_id, 0 FROM kept GROUP BY ALL HAVING count(*) < {ROOM}) JOIN cdm_label USING (person_id)
  GROUP BY person_id, observation_period_id""",
    ),
    "metric_state": (
        EPOCHS,
        f"""SELECT {EPOCH_CELL}, CASE WHEN is_train = 1 THEN 'train' ELSE 'validation' END || ' label prediction ' || name AS metric,
    round(value, 6) AS value FROM (
    SELECT {EPOCH_CELL}, 'mean loss' AS name, mean_loss AS value FROM mean_metric
    UNION ALL SELECT {EPOCH_CELL}, 'AUC', auc FROM ranking UNION ALL SELECT {EPOCH_CELL}, 'AUPRC', auprc FROM ranking
    UNION ALL SELECT {EPOCH_CELL}, 'Brier score', brier FROM mean_metric)""",
    ),
    "roc_auc": (PREDICTIONS, f"SELECT {CELL}, round(auc, 6) AS auc FROM ranking"),
    "average_precision": (PREDICTIONS, f"SELECT {CELL}, round(auprc, 6) AS auprc FROM ranking"),
    "brier_score": (PREDICTIONS, f"SELECT {CELL}, round(brier, 6) AS brier FROM mean_metric"),
    "binary_cross_entropy": (PREDICTIONS, f"SELECT {CELL}, round(mean_loss, 6) AS mean_loss FROM mean_metric"),
    "metric_rows": (
        PREDICTIONS,
        f"""SELECT {CELL}, 'validation label prediction ' || name AS metric, round(value, 6) AS value FROM (
    SELECT {CELL}, 'mean loss' AS name, mean_loss AS value FROM mean_metric
    UNION ALL SELECT {CELL}, 'AUC', auc FROM ranking UNION ALL SELECT {CELL}, 'AUPRC', auprc FROM ranking
    UNION ALL SELECT {CELL}, 'Brier score', brier FROM mean_metric)""",
    ),
    "metric_table": (
        PREDICTIONS,
        f"""SELECT {CELL}, round(mean_loss, 6) AS "validation label prediction mean loss",
    round(auc, 6) AS "validation label prediction AUC", round(auprc, 6) AS "validation label prediction AUPRC",
    round(brier, 6) AS "validation label prediction Brier score"
  FROM ranking JOIN mean_metric USING ({CELL})""",
    ),
    "token_accuracy": (LOGITS, "SELECT round(avg(hit), 6) AS mean_accuracy FROM softmax WHERE NOT ignored"),
    "token_cross_entropy": (LOGITS, "SELECT round(avg(loss), 6) AS mean_loss FROM softmax WHERE NOT ignored"),
    "next_token_metrics": (
        LOGITS,
        "SELECT round(avg(loss), 6) AS mean_loss, round(avg(hit), 6) AS mean_accuracy FROM softmax",
    ),
    "multi_label_metrics": (
        LOGITS,
        f"SELECT round(mean_loss, 6) AS mean_loss, round(mean_accuracy, 6) AS mean_accuracy "
        f"FROM (SELECT {MULTI_LOSS} FROM multi)",
    ),
    "combined_loss": (
        LOGITS,
        f"SELECT round((SELECT avg(loss) FROM softmax WHERE NOT ignored) + (SELECT avg(loss) FROM softmax) "
        f"+ (SELECT mean_loss FROM (SELECT {MULTI_LOSS} FROM multi)), 6) AS combined_loss",
    ),
    "experiment_grid": (
        GRID,
        f"""SELECT *, 'eval_' || {NAME} || '_' || {SETTING} AS evaluation_folder,
  'model_' || {NAME} || '_' || {SETTING} || '_' || regexp_replace(train_label, '[^A-Za-z0-9]', '', 'g') AS model_folder
  FROM grid""",
    ),
    "combined_results": (
        GRID,
        "SELECT fine_tuned_model, pretrained_model, pretrained_epoch, test_label, round(brier, 6) AS brier, "
        "round(mean_loss, 6) AS mean_loss FROM combined",
    ),
    "result_summary": (
        GRID,
        "SELECT pretrained_model, fine_tuned_model, pretrained_epoch, round(avg(brier), 6) AS brier, "
        "round(avg(mean_loss), 6) AS mean_loss FROM combined GROUP BY 1, 2, 3",
    ),
    "result_summary_pretrained": (
        GRID,
        "SELECT pretrained_model, round(avg(pretrained_epoch), 6) AS pretrained_epoch, round(avg(brier), 6) AS brier, "
        "round(avg(mean_loss), 6) AS mean_loss FROM combined GROUP BY 1",
    ),
    "cohort_statistics": (
        CDM,
        """SELECT (SELECT count(*) FROM cdm_person) AS persons, count(*) AS visits,
  round((SELECT sum(date_diff('day', op_start, op_end)) FROM cdm_period) / count(*), 6) AS mean_days_between_visits,
  round((SELECT count(*) FROM event_base WHERE l_returnflag = 'A') / count(*), 6) AS mean_concepts_per_visit,
  (SELECT count(DISTINCT concept_id) FROM event_base WHERE l_returnflag = 'A') AS unique_concepts,
  round(100 * count(*) FILTER (WHERE visit_concept_id = 9203) / count(*), 6) AS percent_er_visits FROM cdm_visit""",
    ),
    "label_prevalence": (
        COHORT,
        "SELECT round(100 * avg(share), 6) AS percent_positive FROM (SELECT avg(label) AS share FROM window_label "
        "GROUP BY concept_id)",
    ),
    "label_counts": (CDM, "SELECT CAST(label AS INT) AS label, count(*) AS n FROM cdm_label GROUP BY 1"),
    "repeated_labels": (
        CDM,
        "SELECT o_custkey AS person_id, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 1",
    ),
    "array_check": (
        TOKENS,
        f"""SELECT a AS "array", count(*) AS sequences, count(*) FILTER (num_of_concepts <> length) AS unequal FROM (
    {per_period('count(concept_ids) AS num_of_concepts, count(*) AS length', 'token')}),
    (VALUES ('concept_ids'), ('visit_segments'), ('dates'), ('ages'), ('visit_concept_orders'), ('orders')) AS n(a)
  GROUP BY a""",
    ),
    "dense_visits": (
        TOKENS,
        """SELECT sum(visits) AS total_visits, sum(CASE WHEN visits > days / 2 THEN visits ELSE 0 END) AS dense_visits,
    round(sum(CASE WHEN visits > days / 2 THEN visits ELSE 0 END) / sum(visits), 6) AS dense_share
  FROM (SELECT max(visit_concept_orders) AS visits, (max(dates) - min(dates)) * 7 AS days FROM token
    GROUP BY observation_period_id)""",
    ),
    "concept_choice": (COHORT, "SELECT concept_id FROM chosen"),
    "window_labels": (COHORT, "SELECT * FROM window_label"),
    "positive_labels": (COHORT, "SELECT person_id, observation_period_id, concept_id FROM window_label WHERE label = 1"),
    "history_events": (
        LINK,
        """SELECT e.person_id, observation_period_id, concept_id, CAST(start_date AS VARCHAR) AS start_date
  FROM event_distinct e JOIN cdm_period p ON e.person_id = p.person_id AND start_date >= op_start
    AND start_date <= op_end - 180""",
    ),
    "cdm_files": (
        CDM,
        """SELECT 'person' AS table_name, count(*) AS n, count(DISTINCT person_id) AS persons FROM cdm_person
  UNION ALL SELECT 'observation_period', count(*), count(DISTINCT person_id) FROM cdm_period
  UNION ALL SELECT 'visit_occurrence', count(*), count(DISTINCT person_id) FROM cdm_visit
  UNION ALL SELECT 'condition_occurrence', count(*), count(DISTINCT person_id) FROM event_base WHERE l_returnflag = 'A'
  UNION ALL SELECT 'drug_exposure', count(*), count(DISTINCT person_id) FROM cdm_drug
  UNION ALL SELECT 'measurement', count(*), count(DISTINCT person_id) FROM event_base
    WHERE l_returnflag = 'N' AND l_linestatus = 'F'
  UNION ALL SELECT 'procedure_occurrence', count(*), count(DISTINCT person_id) FROM event_base
    WHERE l_returnflag = 'N' AND l_linestatus = 'O'
  UNION ALL SELECT 'death', count(*), count(DISTINCT person_id) FROM cdm_death""",
    ),
    "cdm_visit_file": (
        CDM,
        "SELECT person_id, visit_occurrence_id, CAST(visit_start_date AS VARCHAR) AS visit_start_date, "
        "CAST(visit_end_date AS VARCHAR) AS visit_end_date, visit_concept_id FROM cdm_visit",
    ),
    "bucketed_drug_table": (
        CDM,
        "SELECT person_id, CAST(start_date AS VARCHAR) AS drug_exposure_start_date, drug_id AS drug_concept_id, visit_occurrence_id FROM cdm_drug",
    ),
    "label_files": (
        COHORT,
        "SELECT concept_id, person_id, label FROM window_label",
    ),
    "vocabulary_files": (VOCABULARY, "SELECT token, token_id FROM vocab"),
    "metric_files": (
        GRID,
        "SELECT fine_tuned_model, pretrained_model, 'eval_study' AS evaluation_folder, test_label, "
        "round(brier, 6) AS brier, round(mean_loss, 6) AS mean_loss FROM cell_metric",
    ),
    "settings_record": (
        EVENTS,
        "SELECT count(*) AS events, 1 AS map_drugs_to_ingredients, 1 AS missing_visit_concept_id FROM event_distinct",
    ),
    "visit_types": (
        LINK,
        """SELECT house_person AS visit_person_id, place AS visit_seq, CASE WHEN max(CASE WHEN concept_id % 10 = 0 THEN 1 ELSE 0 END) = 1 THEN 9203
    ELSE 9201 END AS visit_concept_id FROM housed GROUP BY 1, 2""",
    ),
}


_PARTS["sequence_files"] = _PARTS["bucketed_sequences"] = _PARTS["sequences"]
_PARTS["bucketed_link_by_date"] = _PARTS["link_by_date"]

# Whole numbers that come out narrower or wider than 64 bits.
_WHOLE_NUMBERS = {
    "label_scan": ["label"],
    "gender_concept": ["gender_concept_id"],
    "new_visits": ["visit_concept_id"],
    "all_visits": ["visit_concept_id"],
    "interval_token_rows": ["visit_segments", "dates", "ages"],
    "sequences": ["part", "last_visit_start"],
    "labelled_sequences": ["part", "label", "last_visit_start"],
    "vocabulary_facts": [
        "padding_id",
        "mask_id",
        "out_of_vocabulary_id",
        "classification_id",
        "first_token_id",
    ],
    "label_counts": ["label"],
    "window_labels": ["label"],
    "dense_visits": ["total_visits", "dense_visits"],
    "visit_types": ["visit_concept_id"],
    "label_files": ["label"],
    "baseline_fit": ["same"],
    "sequence_files": ["part", "last_visit_start"],
    "bucketed_sequences": ["part", "last_visit_start"],
    "cdm_visit_file": ["visit_concept_id"],
    "baseline_gradient_fit": ["token_id"],
    "metric_state": ["epoch", "is_train"],
    "settings_record": ["map_drugs_to_ingredients", "missing_visit_concept_id"],
}


def _statement(name, ctes, select):
    casts = ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _WHOLE_NUMBERS.get(name, []))
    if casts:
        select = f"SELECT * REPLACE ({casts}) FROM ({select})"
    return f"WITH {ctes} {select}"


SQL = {name: _statement(name, *parts) for name, parts in _PARTS.items()}
