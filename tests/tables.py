"""What several test modules use: the folder of the smallest tables, and rows by key."""

SMALL = "/root/testdata/sf0.001"


def by_id(df, key="encounter_id"):
    return {r[key]: r.asDict() for r in df.collect()}
