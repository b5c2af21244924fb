"""Every rule of the screens over whole documents, planted one by one."""

from types import SimpleNamespace

from corpuslane.plans import catalog
from corpuslane.plans.registry import ENTRIES

FILL = "plain words stand here and there "


def run(spark, name, rows):
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    assert name in catalog.queries()
    return [r[1] for r in sorted(ENTRIES[name].run(SimpleNamespace(documents=df)).collect())]


def test_any_identifier_has_every_rule(spark):
    flagged = ["id 123-45-6789 end", "mail a.b@example.com now", "DOB 1990-01-02 seen", "call (415) 555-0147 soon", "ref 4155550147 sent"]
    clean = ["nothing here", "", None, "chart 4155550147 reviewed", "seen on 1990-01-02", "born " + "x " * 60 + "1990-01-02"]
    # the same beyond the first window, and over the edge of two
    late = [FILL * n + text for text in flagged for n in (58, 60, 200)]
    far = [FILL * 200 + text for text in clean if text]
    rows = flagged + late + clean + far
    assert run(spark, "any_identifier", rows) == [True] * (len(flagged) + len(late)) + [False] * (len(clean) + len(far))


def test_document_warnings_have_every_rule(spark):
    want = {
        "the patient named Zed came": "a patient name", "Mrs. Pemberly called": "a patient name", "my patient, Tobias Van Quillen, asked": "a patient name",
        "see Tobias Quillen's chart today": "a patient name", "mail to 12 Copper Hollow Avenue today": "a street address", "Member ID: AB-000123": "an insurance or member ID",
        "the patient in Lantern Imaging asked": None, "nothing here": None, "": None,
    }
    rows = [*want, *(FILL * 200 + text for text in want), None]
    assert run(spark, "document_warnings", rows) == [*want.values(), *want.values(), None]
