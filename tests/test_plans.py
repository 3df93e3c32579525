"""Plan checks: what reaches the scan, where the shuffles are, that no Python runs in the hot path."""

from votelab.plans import leaderboard as L
from votelab.sources import fixtures as fx
from votelab.sources.tables import read_table

SF = "/root/testdata/sf0.001"
MEMBERS = [m for m, _, _ in fx.MEMBERS]


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_leaderboard_plan_no_python_and_broadcast_combos(spark):
    df = L.leaderboard(fx.gold_table(spark, SF), fx.pred_table(spark, SF), MEMBERS, "majority")
    plan = _plan(df)
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan
    assert "BroadcastHashJoin" in plan or "BroadcastNestedLoopJoin" in plan
    # one data-sized exchange on (lang, id); everything after it is on aggregated data
    assert plan.count("hashpartitioning(lang#") + plan.count("hashpartitioning(lang, id") >= 1


def test_scan_prunes_columns(spark):
    df = fx.gold_table(spark, SF)
    plan = _plan(df)
    # documents.text is never read for the label tables
    assert "text:string" not in plan
    d = read_table(spark, SF, "documents").where("lang = 'fr'").select("doc_id")
    p = _plan(d)
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,fr)]" in p


def test_entry_smoke(spark):
    import __spark_entry__ as entry
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) == 26
    assert set(df.columns) >= {"model", "avg_f1_macro", "avg_accuracy", "process", "n_langs"}


def test_every_query_has_docs_and_every_oracle_a_query(spark):
    import __spark_entry__ as entry
    qs = entry.queries()
    orc = entry.oracle_sql()
    assert len(qs) >= 50
    for name, fn in qs.items():
        assert fn.__doc__, name
    missing = [n for n in orc if n not in qs]
    assert not missing


def test_sweep_has_one_data_sized_shuffle(spark):
    """The sweep's only exchange over data rows is keyed by (lang, id); there is none per cell."""
    import re

    for kind in ("binary", "intensity"):
        g, p = fx.gold_table(spark, SF, kind), fx.pred_table(spark, SF, kind)
        plan = _plan(L.leaderboard(g, p, MEMBERS, "majority", kind))
        assert len(re.findall(r"hashpartitioning\(lang#\d+, id#\d+L?, \d+\)", plan)) == 1, plan
        assert not re.findall(r"hashpartitioning\(lang#\d+, id#\d+L?, label#", plan)


def test_model_eval_has_no_data_join(spark):
    """Per-model evaluation: one data-sized exchange on (lang, id), no sort-merge join."""
    import re

    from votelab.plans import paired as PA

    plan = _plan(PA.multilabel_report(PA.weighted_pairs(fx.gold_table(spark, SF), fx.pred_table(spark, SF)),
                                      ["model", "lang"]))
    assert "SortMergeJoin" not in plan
    assert len(re.findall(r"hashpartitioning\(lang#\d+, id#\d+L?, \d+\)", plan)) == 1, plan
    # the per-cell and per-(row, model) folds reuse that partitioning
    assert not re.findall(r"hashpartitioning\(lang#\d+, id#\d+L?, (label|model)#", plan)


def test_scored_variants_run_the_scorer_once(spark):
    from votelab.plans import queries_models as Q

    assert _plan(Q.eval_variants(spark, SF)).count("MapInPandas") == 1


def test_score_decoding_has_one_exchange(spark):
    from votelab.plans import queries_text as Q

    plan = _plan(Q.score_to_binary(spark, SF))
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan


def test_materialised_votes_use_no_lambda(spark):
    plan = _plan(L.ensemble_votes(fx.pred_table(spark, SF), MEMBERS, "majority"))
    assert "lambdafunction" not in plan
