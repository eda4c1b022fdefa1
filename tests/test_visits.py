import random

from ehrseq.operators import numbering
from ehrseq.operators import visits as vs
from ehrseq.operators.events import union_domain_tables
from ehrseq.operators.numbering import busy_persons
from ehrseq.operators.ranges import first_covering_visit, within_period
from ehrseq.staging import Staging
from tests.conftest import day, rows

VISIT = "person_id bigint, visit_occurrence_id bigint, visit_start_date date, visit_end_date date, visit_concept_id bigint"
EVENT = "person_id bigint, start_date date, concept_id bigint, visit_occurrence_id bigint"


def test_events_find_their_visits(cdm):
    linked = vs.link_events_to_visits(union_domain_tables(cdm), cdm["visit_occurrence"])
    joined = linked.events.join(
        linked.visits.withColumnRenamed("person_id", "visit_person_id"), ["visit_person_id", "visit_seq"]
    )
    assert rows(joined, "concept_id", "visit_start_date", "visit_concept_id") == [
        (0, day("2010-08-02"), 0),
        (4306655, day("2019-11-30"), 0),
        (811, day("2010-04-10"), 9201),
        (822, day("2010-06-20"), 9203),
    ]
    assert linked.visits.count() == 5
    assert linked.visits.select("person_id", "visit_seq").distinct().count() == 5
    assert linked.statistics.first().asDict() == {
        "mapped_by_id": 1,
        "mapped_by_date": 1,
        "mapped_to_new_visit": 2,
        "used_new_visit": 2,
        "new_visits": 2,
        "existing_visits": 3,
    }


def test_a_visit_id_wins_over_person_and_date(spark):
    """The id is not checked against the person, and an event linked by id on a day that gets a
    new visit is counted among that visit's events, though it belongs to the other."""
    visits = spark.createDataFrame([(2, 7, day("2001-01-01"), day("2001-01-01"), 9201)], VISIT)
    events = spark.createDataFrame([(1, day("2000-01-01"), 5, 7), (1, day("2000-01-01"), 6, None)], EVENT)
    linked = vs.link_events_to_visits(events, visits)
    assert rows(linked.events, "concept_id", "person_id", "visit_person_id") == [(5, 1, 2), (6, 1, 1)]
    statistics = linked.statistics.first()
    assert (statistics.mapped_by_id, statistics.mapped_to_new_visit, statistics.used_new_visit) == (1, 2, 1)


def test_events_that_become_equal_collapse(spark):
    visits = spark.createDataFrame([(1, 7, day("2000-01-01"), day("2000-01-01"), 9201)], VISIT)
    unknown = [(1, day("2000-01-01"), 5, 99), (1, day("2000-01-01"), 5, None), (1, day("2000-01-01"), 5, 98)]
    linked = vs.link_events_to_visits(spark.createDataFrame(unknown, EVENT), visits)
    assert linked.events.count() == 1


def test_a_repeated_visit_id_multiplies_events(spark):
    twice = [(1, 7, day("2000-01-01"), day("2000-01-01"), 9201)] * 2
    linked = vs.link_events_to_visits(
        spark.createDataFrame([(1, day("2000-01-01"), 5, 7)], EVENT), spark.createDataFrame(twice, VISIT)
    )
    assert linked.events.count() == 2
    assert linked.visits.select("visit_seq").distinct().count() == 2


def _random_visits(generator, persons, n):
    made = []
    for i in range(n):
        start = day("2000-01-01").toordinal() + generator.randrange(0, 400)
        length = generator.choice([-3, 0, 0, 2, 10, 90])
        made.append(
            (
                generator.randrange(persons),
                i,
                day("2000-01-01").fromordinal(start),
                day("2000-01-01").fromordinal(start + length),
                9201,
            )
        )
    return made


def test_first_covering_visit_matches_trying_them_all(spark):
    generator = random.Random(3)
    made = _random_visits(generator, 3, 60)
    visits = spark.createDataFrame(made, VISIT)
    keyed = vs.key_visits(visits)
    seq = {r.visit_occurrence_id: r.visit_seq for r in keyed.collect()}
    days = [(p, day("1999-12-20").fromordinal(day("1999-12-20").toordinal() + d)) for p in range(4) for d in range(520)]
    expected = []
    for person, date in days:
        covering = [seq[v[1]] for v in made if v[0] == person and v[2] <= date <= v[3]]
        expected.append((person, date, min(covering) if covering else None))
    frame = spark.createDataFrame(days, "person_id bigint, start_date date")
    busy = busy_persons([visits], Staging(spark), max_rows=18)
    assert busy is not None
    for cut in (None, busy):
        assert rows(first_covering_visit(frame, keyed, cut)) == sorted(expected, key=str)


def test_many_visits_of_a_day_spread(spark, monkeypatch):
    """A busy person's visits of one day fall into blocks, and the first covering visit stays the same."""
    monkeypatch.setattr(numbering, "VISITS_PER_BLOCK", 10)
    new_year = day("2000-01-01")
    made = [(1, i, new_year, new_year.fromordinal(new_year.toordinal() + i % 7), 9201) for i in range(200)]
    made += [(1, 900 + i, new_year.fromordinal(new_year.toordinal() + 5 * i), day("2000-02-20"), 9201) for i in range(8)]
    made += [(2, 990, new_year, new_year, 9201)]
    visits = spark.createDataFrame(made, VISIT)
    keyed = vs.key_visits(visits)
    busy = busy_persons([visits], Staging(spark), max_rows=5)
    sizes = [r["count"] for r in numbering.visit_block(keyed, busy).where("person_id = 1").groupBy("_block").count().collect()]
    assert len(sizes) >= 20 and max(sizes) <= 10
    days = [(p, new_year.fromordinal(new_year.toordinal() + d)) for p in (1, 2) for d in range(-2, 60)]
    frame = spark.createDataFrame(days, "person_id bigint, start_date date")
    assert rows(first_covering_visit(frame, keyed, busy)) == rows(first_covering_visit(frame, keyed))


def test_periods_match_trying_them_all(spark):
    generator = random.Random(4)
    made = _random_visits(generator, 3, 50)
    visits = spark.createDataFrame(made, VISIT)
    spans = [(0, "1999-01-01", "2000-03-01"), (0, "2000-02-01", "9999-12-31"), (1, "2000-06-01", "2000-06-30"), (2, "1990-01-01", "1990-02-01")]
    periods = spark.createDataFrame(
        [(p, i, day(s), day(e)) for i, (p, s, e) in enumerate(spans)],
        "person_id bigint, observation_period_id bigint, observation_period_start_date date, "
        "observation_period_end_date date",
    )
    expected = sorted(
        [(v[1], i) for v in made for i, (p, s, e) in enumerate(spans) if v[0] == p and day(s) <= v[2] <= day(e)],
        key=str,
    )
    busy = busy_persons([visits, periods], Staging(spark), max_rows=5)
    for cut in (None, busy):
        inside = within_period(visits, "visit_start_date", periods, cut)
        assert rows(inside, "visit_occurrence_id", "observation_period_id") == expected


def test_no_busy_person_is_none(spark, cdm):
    assert busy_persons([cdm["visit_occurrence"]], Staging(spark)) is None


def test_busy_days_are_numbered_alike(spark):
    made = [
        (1, i, day("2000-01-01"), end, 9201)
        for i in (-5, 3, 99_999, 100_000, 250_000, None)
        for end in (day("2000-01-01"), day("2000-01-09"), None)
    ] + [(2, 4, day("2000-01-01"), day("2000-01-01"), 9201), (None, 8, None, None, 9201), (1, 9, None, None, 9201)]
    visits = spark.createDataFrame(made, VISIT)
    busy = busy_persons([visits], Staging(spark), 3)
    assert rows(vs.key_visits(visits)) == rows(vs.key_visits(visits, busy))
    assert vs.key_visits(visits, busy).select("person_id", "visit_seq").distinct().count() == len(made)
