"""A small made world of accounts and transactions whose facts are known.

Network 1 has account 10: money in on day 10, terminal event on day 20, label [10, 21), known on day 70. Network 2 has
account 12: money in on day 5, terminal on day 7, label [5, 8), known on day 30. Network 3 is never known, 4 is of an
out-of-distribution family.
"""

from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.schema import spec

DAY = 86_400
SIM_END = 90 * DAY
RISKY = 1

TXN = [
    # event_id, day, type, channel, src, dst, amount, src before, dst before
    (1, 5, "INBOUND_CREDIT", "INBOUND_EXTERNAL", 99, 12, 500, 0, 1000),
    (2, 7, "TRANSFER", "SCHEDULED", 12, 11, 400, 1500, 1000),
    (3, 10, "INBOUND_CREDIT", "INBOUND_EXTERNAL", 99, 10, 900, -500, 1000),
    (4, 20, "TRANSFER", "SCHEDULED", 10, 11, 800, 1900, 1400),
    (5, 60, "TRANSFER", "SCHEDULED", 11, 13, 100, 2200, 1000),
]


def frame(spark: SparkSession, name: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, spec(name).schema)


def transactions(spark, rows=TXN) -> DataFrame:
    out = []
    for event, day, kind, channel, src, dst, amount, src_before, dst_before in rows:
        out.append((event, day * DAY + 100, kind, channel, src, dst, None, None, amount, 0, None, None, None, "SETTLED", src_before, src_before - amount, dst_before, dst_before + amount))
    return frame(spark, "transactions", out)


def accounts(spark) -> DataFrame:
    own = [(i, "internal", None, i, -10 * DAY, None, 0, 1000, 0) for i in (10, 11, 12, 13)]
    return frame(spark, "accounts", [*own, (99, "external", "external_world", None, -100 * DAY, None, None, 0, None)])


def labels(spark) -> DataFrame:
    def row(account, start, end, network, known, ood=False):
        return ("account", account, start * DAY, end * DAY, RISKY, "RELAY", f"s:{network}", network, "cycle" if ood else "fan_in", "MOVEMENT", ood, known and known * DAY)

    return frame(spark, "labels", [row(10, 10, 21, 1, 70), row(12, 5, 8, 2, 30), row(13, 40, 50, 3, None), row(11, 41, 50, 4, 60, True)])


def high_risk(spark) -> DataFrame:
    return spark.createDataFrame([(10, 20 * DAY, 70 * DAY, False), (12, 7 * DAY, 30 * DAY, False)], "account_id bigint, ts bigint, known_at bigint, is_ood_family boolean")


def networks(spark) -> DataFrame:
    def row(n, known, ood=False):
        return (n, f"s:{n}", "fan_in", n, ood, 0, 1, None, False, 1, 0, 1, known is not None, known, 100 * n, 1, 1, 1, 1, 1)

    return frame(spark, "ground_truth_networks", [row(1, 70 * DAY), row(2, 30 * DAY), row(3, None), row(4, 60 * DAY, True)])


def members(spark) -> DataFrame:
    return frame(spark, "network_members", [(1, "account", 10, "RELAY", 0, False), (2, "account", 12, "RELAY", 0, False), (4, "account", 11, "RELAY", 0, False)])


def tables(spark) -> dict[str, DataFrame]:
    empty = {n: frame(spark, n, []) for n in ("persons", "devices", "ips", "atms", "merchants", "relations", "logins", "event_labels")}
    return empty | {"transactions": transactions(spark), "accounts": accounts(spark), "labels": labels(spark), "ground_truth_networks": networks(spark), "network_members": members(spark)}
