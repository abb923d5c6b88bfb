"""A session for all tests."""

import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from tidemark.session import local_session

    return local_session(4, partitions=4, memory="4g")


@pytest.fixture
def scratch(spark):
    from tidemark.session import Scratch

    s = Scratch(spark, "test")
    yield s
    s.close()


def rows(df, *columns):
    """Contents as a sorted list of tuples."""
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=lambda r: tuple((x is not None, str(type(x)), x) for x in r))


def most_rows_of_a_task(spark, action, least_tasks=8):
    """The most rows that a task read from shuffles while `action` ran, with partitions as they are, none merged."""
    settings = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": str(least_tasks)}
    before = {k: spark.conf.get(k) for k in settings}
    store = spark.sparkContext._jsc.sc().statusStore()

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        old = set(stages())
        action()
        most = 0
        for number, stage in stages().items():
            if number not in old and stage.numCompleteTasks():
                tasks = store.taskList(number, stage.attemptId(), 100_000)
                for i in range(tasks.size()):
                    metrics = tasks.apply(i).taskMetrics()
                    if metrics.isDefined():
                        most = max(most, metrics.get().shuffleReadMetrics().recordsRead())
        return most
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
