"""The clinical rules once more, as plain loops over raw rows; the tests compare against this."""

from datetime import date, datetime, timedelta

from anchorline.contracts import FLAG_CODES


def instant(text):
    return datetime.strptime(text, "%Y-%m-%dT%H:%M:%SZ") if text else None


def day(text):
    return date.fromisoformat(text) if text else None


def admitted(rows):
    people = {p["Id"]: p for p in rows["patients"]}
    out = []
    for e in rows["encounters"]:
        if e["ENCOUNTERCLASS"] != "inpatient" or not e["STOP"] or e["PATIENT"] not in people:
            continue
        start, stop = instant(e["START"]), instant(e["STOP"])
        birth, death = day(people[e["PATIENT"]]["BIRTHDATE"]), day(people[e["PATIENT"]]["DEATHDATE"])
        age = stop.year - birth.year - ((stop.month, stop.day) < (birth.month, birth.day))
        if (death and death <= stop.date()) or age < 18:
            continue
        out.append((e, start, stop, age))
    return out


def features(rows):
    out = {}
    for e, start, stop, age in admitted(rows):
        own = lambda name: [r for r in rows[name] if r["PATIENT"] == e["PATIENT"]]
        past = [(instant(r["STOP"]), r["ENCOUNTERCLASS"]) for r in own("encounters") if r["STOP"] and r["Id"] != e["Id"]]
        past = [(s, c) for s, c in past if s < stop]
        recent = [(s, c) for s, c in past if s >= stop - timedelta(days=180)]
        prev = max((s for s, c in past if c == "inpatient"), default=None)
        gap = 365.0 if prev is None else min(365.0, max(0.0, (start - prev).total_seconds() / 86400))
        courses = [r for r in own("medications") if instant(r["START"]) <= stop and (not r["STOP"] or instant(r["STOP"]) > stop)]
        known = [r for r in own("conditions") if day(r["START"]) <= stop.date()]
        active = [r for r in known if (not r["STOP"] or day(r["STOP"]) > stop.date()) and r["DESCRIPTION"].endswith("(disorder)")]
        row = {
            "patient_id": e["PATIENT"], "age_at_discharge": age, "los_days": (stop - start).total_seconds() / 86400,
            "prior_inpatient_180d": sum(c == "inpatient" for _, c in recent), "days_since_prev_discharge": gap,
            "prior_ed_180d": sum(c == "emergency" for _, c in recent), "active_medication_count": len(courses),
            "active_disorder_count": len(active),
        }
        for flag, codes in FLAG_CODES.items():
            row[flag] = int(any(
                r["CODE"] in codes or (flag == "flag_malignancy" and r["SYSTEM"] == "ICD10" and r["CODE"].startswith("C"))
                for r in known
            ))
        out[e["Id"]] = row
    return out


def labels(rows):
    out = {}
    for e, _, stop, _ in admitted(rows):
        out[e["Id"]] = int(any(
            r["PATIENT"] == e["PATIENT"] and r["ENCOUNTERCLASS"] == "inpatient" and r["Id"] != e["Id"]
            and stop < instant(r["START"]) <= stop + timedelta(days=30)
            for r in rows["encounters"]
        ))
    return out


def auroc(scores, y, w=None):
    w = w or [1] * len(y)
    wins = total = 0.0
    for s1, y1, w1 in zip(scores, y, w):
        for s0, y0, w0 in zip(scores, y, w):
            if y1 == 1 and y0 == 0:
                wins += w1 * w0 * (1.0 if s1 > s0 else 0.5 if s1 == s0 else 0.0)
                total += w1 * w0
    return wins / total if total else None


def average_precision(scores, y):
    total, hits, seen, out = sum(y), 0, 0, 0.0
    for s in sorted(set(scores), reverse=True):
        here = [v for t, v in zip(scores, y) if t == s]
        hits, seen = hits + sum(here), seen + len(here)
        out += sum(here) / total * hits / seen
    return out
