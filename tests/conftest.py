import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from anchorline.contracts import TABLES  # noqa: E402
from anchorline.session import local_session  # noqa: E402
from anchorline.sources.raw import typed_population  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", shuffle_partitions=4, memory="6g")
    yield session
    session.stop()


class Population:
    """Raw text rows, built up by the tests."""

    def __init__(self):
        self.rows = {name: [] for name in TABLES}

    def patient(self, id, birth="1950-06-15", death="", gender="F"):
        self.rows["patients"].append({"Id": id, "BIRTHDATE": birth, "DEATHDATE": death, "GENDER": gender})
        return self

    def stay(self, id, patient, start, stop, kind="inpatient"):
        self.rows["encounters"].append(
            {"Id": id, "START": start, "STOP": stop, "PATIENT": patient, "ENCOUNTERCLASS": kind}
        )
        return self

    def course(self, patient, start, stop="", code="m1", encounter="e0"):
        self.rows["medications"].append(
            {"START": start, "STOP": stop, "PATIENT": patient, "ENCOUNTER": encounter, "CODE": code}
        )
        return self

    def diagnosis(self, patient, start, stop="", code="1", text="Something (disorder)", system="SNOMED-CT", encounter="e0"):
        self.rows["conditions"].append({
            "START": start, "STOP": stop, "PATIENT": patient, "ENCOUNTER": encounter, "SYSTEM": system, "CODE": code,
            "DESCRIPTION": text,
        })
        return self

    def raw(self, spark):
        frames = {}
        for name, rows in self.rows.items():
            columns = TABLES[name].payload + (("GENDER",) if name == "patients" else ())
            schema = ", ".join(f"{c} STRING" for c in columns)
            frames[name] = spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], schema)
        return frames

    def typed(self, spark):
        return typed_population(self.raw(spark))


@pytest.fixture
def population():
    return Population()
