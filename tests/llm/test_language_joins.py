"""No side of a join that grows with the corpus is broadcast, however small its compressed file is."""

import re

from pyspark.sql import functions as F

from fathom.llm import language
from fathom.shared import Tables


def test_vocabulary_is_not_broadcast(spark, monkeypatch):
    plans, write = [], Tables.written

    def seen(self, df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return write(self, df, name)

    monkeypatch.setattr(Tables, "written", seen)
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("der hund und die katze", None), ("catty doggo", None)])]
    found = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), F.lit(True))
    assert {r.doc_id: r.lang_pred for r in found.collect()}[3] == "en"
    sent = [(name, line.strip()) for name, plan in plans for line in plan.splitlines() if re.search(r"Broadcast\w*Join", line)]
    # What is left are hot keys and a row for each language.
    assert {name for name, _ in plans} >= {"unseen", "spelt", "hits"}
    assert not [x for x in sent if not re.search(r"\[lang#\d+", x[1])]
