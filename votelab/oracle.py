"""DuckDB text of the registered queries: the independent side of the correctness check.

Written in the plain, exploded form (join every prediction to its combos, aggregate, join gold),
so it checks the compact Spark plans rather than repeating them. Fixture views come from
:mod:`votelab.sources.fixtures` (``with_ctes``).
"""

from __future__ import annotations

from .sources.fixtures import MEMBERS, with_ctes

METRICS = ["f1_macro", "precision_macro", "recall_macro", "f1_micro", "precision_micro", "recall_micro",
           "f1_weighted", "precision_weighted", "recall_weighted", "accuracy"]


def sdiv(num: str, den: str) -> str:
    return f"(CASE WHEN ({den}) <> 0 THEN CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE) ELSE 0.0::DOUBLE END)"


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def combo_ctes(min_size: int = 2, max_size: int | None = None, members_view: str = "members") -> dict[str, str]:
    """mem(model, bit), cm(mask, model, bit), combos(mask, combo, r) from a member view in list order."""
    n = len(MEMBERS)
    hi = n if max_size is None else max_size
    return {
        "mem": f"SELECT model, CAST(idx - 1 AS INTEGER) AS bit FROM {members_view}",
        "masks": f"SELECT CAST(range AS BIGINT) AS mask FROM range(1, {1 << n})",
        "cm": "SELECT k.mask, m.model, m.bit FROM masks k JOIN mem m ON ((k.mask >> m.bit) & 1) = 1",
        "combos": (f"SELECT mask, string_agg(model, '_' ORDER BY bit) AS combo, CAST(count(*) AS INTEGER) AS r "
                   f"FROM cm GROUP BY mask HAVING count(*) BETWEEN {min_size} AND {hi}"),
    }


def avail_ctes(pred_view: str = "pred") -> dict[str, str]:
    return {
        "lang_models": f"SELECT DISTINCT lang, model FROM {pred_view}",
        "avail": ("SELECT c.mask, c.combo, c.r, l.lang FROM combos c JOIN cm ON cm.mask = c.mask "
                  "JOIN lang_models l ON l.model = cm.model GROUP BY c.mask, c.combo, c.r, l.lang "
                  "HAVING count(*) = c.r"),
    }


def decide_sql(rule: str, kind: str, s: str = "s", mx: str = "mx", r: str = "r") -> str:
    if kind == "binary_union":
        return f"CAST(CASE WHEN {s} > 0 THEN 1 ELSE 0 END AS INTEGER)"
    thr = f"({r} // 2 + 1)" if rule == "majority" else "1"
    if kind == "binary":
        return f"CAST(CASE WHEN {s} >= {thr} THEN 1 ELSE 0 END AS INTEGER)"
    return f"CAST(CASE WHEN {s} >= {thr} THEN {mx} ELSE 0 END AS INTEGER)"


def vote_ctes(rule: str, kind: str, value: str, suffix: str = "") -> dict[str, str]:
    """ens{suffix}(combo, lang, id, label, value) over available (combo, lang) pairs."""
    return {
        f"votes{suffix}": (f"SELECT c.combo, c.r, p.lang, p.id, p.label, sum(p.{value}) AS s, max(p.{value}) AS mx "
                           f"FROM pred p JOIN cm ON cm.model = p.model JOIN combos c ON c.mask = cm.mask "
                           f"JOIN avail a ON a.mask = c.mask AND a.lang = p.lang "
                           f"GROUP BY c.combo, c.r, p.lang, p.id, p.label"),
        f"ens{suffix}": f"SELECT combo, lang, id, label, {decide_sql(rule, kind)} AS value FROM votes{suffix}",
    }


def multilabel_ctes(pairs: str, keys: list[str]) -> dict[str, str]:
    """per_key(keys..., 10 metrics) from pairs(keys..., id, label, g, p)."""
    k = ", ".join(keys)
    return {
        "lc": (f"SELECT {k}, label, sum(CASE WHEN g >= 1 AND p >= 1 THEN 1 ELSE 0 END) AS tp, "
               f"sum(CASE WHEN g < 1 AND p >= 1 THEN 1 ELSE 0 END) AS fp, "
               f"sum(CASE WHEN g >= 1 AND p < 1 THEN 1 ELSE 0 END) AS fn FROM {pairs} GROUP BY {k}, label"),
        "lm": (f"SELECT {k}, label, tp, fp, fn, tp + fn AS sup, {sdiv('tp', 'tp + fp')} AS pr, "
               f"{sdiv('tp', 'tp + fn')} AS rc, {sdiv('2 * tp', '2 * tp + fp + fn')} AS f FROM lc"),
        "ml": (f"SELECT {k}, avg(f) AS f1_macro, avg(pr) AS precision_macro, avg(rc) AS recall_macro, "
               f"{sdiv('2 * sum(tp)', '2 * sum(tp) + sum(fp) + sum(fn)')} AS f1_micro, "
               f"{sdiv('sum(tp)', 'sum(tp) + sum(fp)')} AS precision_micro, "
               f"{sdiv('sum(tp)', 'sum(tp) + sum(fn)')} AS recall_micro, "
               f"{sdiv('sum(f * sup)', 'sum(sup)')} AS f1_weighted, "
               f"{sdiv('sum(pr * sup)', 'sum(sup)')} AS precision_weighted, "
               f"{sdiv('sum(rc * sup)', 'sum(sup)')} AS recall_weighted, CAST(count(*) AS BIGINT) AS n_labels "
               f"FROM lm GROUP BY {k}"),
        "rows_ok": f"SELECT {k}, id, min(CASE WHEN g = p THEN 1 ELSE 0 END) AS ok FROM {pairs} GROUP BY {k}, id",
        "acc": f"SELECT {k}, avg(CAST(ok AS DOUBLE)) AS accuracy, count(*) AS n_rows FROM rows_ok GROUP BY {k}",
        "per_key": f"SELECT ml.*, acc.accuracy, acc.n_rows FROM ml JOIN acc USING ({k})",
    }


def multiclass_ctes(pairs: str, keys: list[str]) -> dict[str, str]:
    """per_key(keys..., 10 metrics) averaged over labels, from pairs(keys..., id, label, g, p)."""
    k = ", ".join(keys)
    return {
        "cube": f"SELECT {k}, label, g, p, count(*) AS n FROM {pairs} GROUP BY {k}, label, g, p",
        "classes": (f"SELECT {k}, label, c, sum(sup) AS sup, sum(pc) AS pc, sum(tp) AS tp FROM ("
                    f"SELECT {k}, label, g AS c, n AS sup, 0 AS pc, CASE WHEN g = p THEN n ELSE 0 END AS tp FROM cube "
                    f"UNION ALL SELECT {k}, label, p AS c, 0 AS sup, n AS pc, 0 AS tp FROM cube) "
                    f"GROUP BY {k}, label, c"),
        "cm_": (f"SELECT {k}, label, sup, tp, {sdiv('tp', 'pc')} AS pr, {sdiv('tp', 'sup')} AS rc, "
                f"{sdiv('2 * tp', 'pc + sup')} AS f FROM classes"),
        "per_label": (f"SELECT {k}, label, avg(f) AS f1_macro, avg(pr) AS precision_macro, avg(rc) AS recall_macro, "
                      f"{sdiv('sum(tp)', 'sum(sup)')} AS f1_micro, {sdiv('sum(tp)', 'sum(sup)')} AS precision_micro, "
                      f"{sdiv('sum(tp)', 'sum(sup)')} AS recall_micro, {sdiv('sum(f * sup)', 'sum(sup)')} AS f1_weighted, "
                      f"{sdiv('sum(pr * sup)', 'sum(sup)')} AS precision_weighted, "
                      f"{sdiv('sum(rc * sup)', 'sum(sup)')} AS recall_weighted, "
                      f"{sdiv('sum(tp)', 'sum(sup)')} AS accuracy FROM cm_ GROUP BY {k}, label"),
        "per_key": (f"SELECT {k}, " + ", ".join(f"avg({m}) AS {m}" for m in METRICS) +
                    f", CAST(count(*) AS BIGINT) AS n_labels FROM per_label GROUP BY {k}"),
    }


def leaderboard_sql(rule: str, kind: str, process: str | None = None, min_size: int = 2,
                    max_size: int | None = None) -> str:
    value = "pred" if kind == "binary" else "pred_b"
    gcol = "gold" if kind == "binary" else "gold_b"
    ctes = {}
    ctes.update(combo_ctes(min_size, max_size))
    ctes.update(avail_ctes())
    ctes.update(vote_ctes(rule, kind, value))
    ctes["pairs"] = (f"SELECT e.combo, e.lang, e.id, e.label, g.{gcol} AS g, e.value AS p FROM ens e "
                     f"JOIN gold g ON g.lang = e.lang AND g.id = e.id AND g.label = e.label")
    ctes.update((multilabel_ctes if kind == "binary" else multiclass_ctes)("pairs", ["combo", "lang"]))
    proc = process if process is not None else {"majority": "majority voting", "union": "union rule"}[rule]
    cols = ", ".join(f"{r6(f'avg({m})')} AS avg_{m}" for m in METRICS)
    body = (f"SELECT combo AS model, {cols}, '{proc}' AS process, CAST(count(*) AS BIGINT) AS n_langs "
            f"FROM per_key GROUP BY combo")
    return with_ctes(body, ctes)


def per_language_sql(rule: str, kind: str, min_size: int = 2, max_size: int | None = None) -> str:
    """(combo, lang, 10 metrics rounded) for every available (combo, language)."""
    value = "pred" if kind == "binary" else "pred_b"
    gcol = "gold" if kind == "binary" else "gold_b"
    ctes = {}
    ctes.update(combo_ctes(min_size, max_size))
    ctes.update(avail_ctes())
    ctes.update(vote_ctes(rule, kind, value))
    ctes["pairs"] = (f"SELECT e.combo, e.lang, e.id, e.label, g.{gcol} AS g, e.value AS p FROM ens e "
                     f"JOIN gold g ON g.lang = e.lang AND g.id = e.id AND g.label = e.label")
    ctes.update((multilabel_ctes if kind == "binary" else multiclass_ctes)("pairs", ["combo", "lang"]))
    cols = ", ".join(f"{r6(m)} AS {m}" for m in METRICS)
    return with_ctes(f"SELECT combo, lang, {cols} FROM per_key", ctes)


def _metric_cols(prefix: str = "") -> str:
    return ", ".join(f"{r6(prefix + m)} AS {m}" for m in METRICS)


def _single_pairs(kind: str = "binary") -> str:
    g, p = ("gold", "pred") if kind == "binary" else ("gold_b", "pred_b")
    return f"SELECT model, lang, id, label, {g} AS g, {p} AS p FROM pred"


def eval_models_sql() -> str:
    ctes = {"pairs": _single_pairs()}
    ctes.update(multilabel_ctes("pairs", ["model", "lang"]))
    return with_ctes(f"SELECT model, lang, {_metric_cols()}, n_rows FROM per_key", ctes)


def multilabel_prf_sql() -> str:
    ctes = {"pairs": _single_pairs()}
    ctes.update(multilabel_ctes("pairs", ["model", "lang"]))
    cols = ", ".join(f"{r6(m)} AS {m}" for m in METRICS if m != "accuracy")
    return with_ctes(f"SELECT model, lang, {cols}, n_labels FROM ml", ctes)


def subset_accuracy_sql() -> str:
    ctes = {"pairs": _single_pairs()}
    ctes.update(multilabel_ctes("pairs", ["model", "lang"]))
    return with_ctes(f"SELECT model, lang, {r6('accuracy')} AS accuracy, n_rows FROM acc", ctes)


def multiclass_prf_sql() -> str:
    ctes = {"pairs": _single_pairs("intensity")}
    ctes.update(multiclass_ctes("pairs", ["model", "lang"]))
    return with_ctes(f"SELECT model, lang, {_metric_cols()}, n_labels FROM per_key", ctes)


def pearson_sql() -> str:
    ctes = {}
    ctes.update(combo_ctes())
    ctes.update(avail_ctes())
    bodies = []
    for rule, proc in (("majority", "majority voting"), ("union", "union rule")):
        sfx = "_" + rule[:3]
        ctes.update(vote_ctes(rule, "intensity", "pred_b", sfx))
        ctes[f"mom{sfx}"] = (
            f"SELECT e.combo, e.lang, e.label, CAST(count(*) AS DOUBLE) AS k, CAST(sum(g.gold_b) AS DOUBLE) AS sx, "
            f"CAST(sum(e.value) AS DOUBLE) AS sy, CAST(sum(g.gold_b * g.gold_b) AS DOUBLE) AS sxx, "
            f"CAST(sum(e.value * e.value) AS DOUBLE) AS syy, CAST(sum(g.gold_b * e.value) AS DOUBLE) AS sxy "
            f"FROM ens{sfx} e JOIN gold g ON g.lang = e.lang AND g.id = e.id AND g.label = e.label "
            f"GROUP BY e.combo, e.lang, e.label")
        ctes[f"pr{sfx}"] = (
            f"SELECT combo, lang, label, CASE WHEN (k * sxx - sx * sx) > 0 AND (k * syy - sy * sy) > 0 "
            f"THEN (k * sxy - sx * sy) / sqrt((k * sxx - sx * sx) * (k * syy - sy * sy)) END AS pearson FROM mom{sfx}")
        ctes[f"pl{sfx}"] = f"SELECT combo, lang, avg(pearson) AS pearson FROM pr{sfx} GROUP BY combo, lang"
        bodies.append(f"SELECT combo AS model, {r6('avg(pearson)')} AS avg_pearson, "
                      f"CAST(count(pearson) AS BIGINT) AS n_langs, '{proc}' AS process FROM pl{sfx} GROUP BY combo")
    return with_ctes(" UNION ALL ".join(bodies), ctes)
