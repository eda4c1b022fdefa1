import datetime
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ehrseq.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cores=8, shuffle_partitions=4)
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


def day(text):
    return datetime.date.fromisoformat(text)


@pytest.fixture(scope="session")
def cdm(spark):
    """One person: a hospital stay and an emergency in spring, a stay years later, a death after all periods."""
    make = spark.createDataFrame
    return {
        "person": make(
            [(5, 1961, 9, 23, 8532)],
            "person_id bigint, year_of_birth int, month_of_birth int, day_of_birth int, gender_concept_id bigint",
        ),
        "observation_period": make(
            [
                (5, 11, day("2010-03-01"), day("2010-12-31")),
                (5, 12, day("2012-01-01"), day("2012-06-30")),
                (5, 13, day("2015-05-05"), day("2016-05-05")),
            ],
            "person_id bigint, observation_period_id bigint, observation_period_start_date date, "
            "observation_period_end_date date",
        ),
        "visit_occurrence": make(
            [
                (5, 21, day("2010-04-10"), day("2010-04-12"), 9201),
                (5, 22, day("2010-06-20"), day("2010-06-20"), 9203),
                (5, 23, day("2015-05-05"), day("2015-05-09"), 9202),
            ],
            "person_id bigint, visit_occurrence_id bigint, visit_start_date date, visit_end_date date, "
            "visit_concept_id bigint",
        ),
        "condition_occurrence": make(
            [
                (5, day("2010-04-11"), 811, 21),
                (5, day("2010-06-20"), 822, None),
                (5, day("2010-08-02"), 0, None),
            ],
            "person_id bigint, condition_start_date date, condition_concept_id bigint, visit_occurrence_id bigint",
        ),
        "death": make([(5, day("2019-11-30"))], "person_id bigint, death_date date"),
    }


def rows(frame, *columns):
    picked = frame.select(*columns) if columns else frame
    return sorted((tuple(r) for r in picked.collect()), key=str)
