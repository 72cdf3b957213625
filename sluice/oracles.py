"""DuckDB SQL of the engine's queries, written apart from their DataFrame form."""

from __future__ import annotations

from sluice.operators.corpus import BOUNDS
from sluice.plans.predictions import PREDS_SQL

SEED = 42
_METRICS = f"""with {PREDS_SQL},
s as (select pipeline, mode, emb, clf, y_prob as score, sum(y_true) pos, sum(1 - y_true) neg from preds group by all),
c as (select *, sum(pos) over d tp, sum(neg) over d fp, sum(pos) over k p, sum(neg) over k n from s window d as (partition by pipeline, mode, emb, clf order by score desc), k as (partition by pipeline, mode, emb, clf)),
m as (select pipeline, mode, emb, clf, max(p) p, max(n) n, sum(case when score >= 0.5 then pos else 0 end) tp, sum(case when score >= 0.5 then neg else 0 end) fp,
 sum(pos * (2 * (n - fp) + neg)) ordered, sum(pos / p * (tp / (tp + fp))) ap,
 sum(pos / p * (tp / (tp + fp) + case when tp - pos + fp - neg > 0 then (tp - pos) / (tp - pos + fp - neg) else 1 end) / 2) trapz from c group by all),
results as (select pipeline, mode, emb, clf, round((tp + n - fp) / (p + n), 9) accuracy, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) "precision", round(case when p > 0 then tp / p else 0 end, 9) recall,
 round(case when 2 * tp + fp + p - tp > 0 then 2 * tp / (2 * tp + fp + p - tp) else 0 end, 9) f1, round(ordered / (2 * p * n), 9) roc_auc, round(ap, 9) pr_auc, round(trapz, 9) pr_auc_trapz,
 cast(n - fp as bigint) tn, cast(fp as bigint) fp, cast(p - tp as bigint) fn, cast(tp as bigint) tp, round((n - fp) / nullif(n, 0), 9) specificity, round(fp / nullif(n, 0), 9) fpr, round((p - tp) / nullif(p, 0), 9) fnr from m)"""
_RUN = f"""with {PREDS_SQL},
s as (select emb, clf, y_prob as score, sum(y_true) pos, sum(1 - y_true) neg from preds where pipeline = 1 and mode = 'normal' group by all),
c as (select *, sum(pos) over d tp, sum(neg) over d fp, sum(pos) over k p, sum(neg) over k n, lead(pos) over d np, lead(neg) over d nn from s window d as (partition by emb, clf order by score desc), k as (partition by emb, clf)),
pr as (select emb, clf, row_number() over (partition by emb, clf order by score) - 1 point, recall, "precision" from (select emb, clf, cast(score as double) score, tp / p recall, tp / (tp + fp) "precision" from c union all select distinct emb, clf, 9.0, 0.0, 1.0 from c))"""
_RIGHT = "case when y_pred = y_true then 1 else 0 end"
_SF = """case when sqrt(statistic / 2) < 2.5 then 1 - 2 / sqrt(pi()) * exp(-statistic / 2) * list_sum(list_transform(range(0, 61), lambda k: sqrt(statistic / 2) * coalesce(list_product(list_transform(range(1, k + 1), lambda j: statistic / (2 * j + 1))), 1))) else exp(-statistic / 2) / sqrt(pi()) / (sqrt(statistic / 2) + list_reduce(list_prepend(0.0, list_transform(range(0, 60), lambda i: cast(60 - i as double))), lambda t, k: (k / 2) / (sqrt(statistic / 2) + t))) end"""
_TESTS = f"""pairs0 as (select *, b + c n_discordant from counted),
stat as (select *, case when n_discordant = 0 then 0.0 when n_discordant <= 25 then cast(least(b, c) as double) else pow(abs(b - c) - 1, 2) / n_discordant end statistic from pairs0),
tests as (select *, case when n_discordant = 0 then 1.0 when n_discordant <= 25 then least(1.0, 2 * list_sum(list_transform(range(0, least(b, c) + 1), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda i: (n_discordant - i + 1) / i)), 1))) * pow(0.5, n_discordant)) else {_SF} end p_value, case when n_discordant <= 25 then 'exact' else 'chi2_continuity' end "method" from stat)"""


def _holm(family: str, order: str) -> str:
    return f"""holm as (select *, least(1.0, max(step) over (partition by {family} order by p_value, {order} rows unbounded preceding)) p_holm from (select *, (count(*) over (partition by {family}) - row_number() over (partition by {family} order by p_value, {order}) + 1) * p_value step from tests))"""


_TEST_COLUMNS = "round(acc_a, 9) acc_a, round(acc_b, 9) acc_b, b, c, n_discordant, round(statistic, 9) statistic, round(p_value, 9) p_value, \"method\", round(p_holm, 9) p_holm, p_holm < 0.05 significant, round(acc_a - acc_b, 9) acc_diff"
_WITHIN = f"""with {PREDS_SQL}, r as (select pipeline, mode, emb || '__' || clf cfg, row_id, {_RIGHT} ok from preds),
counted as (select x.pipeline, x.mode, x.cfg a, y.cfg b_name, sum(x.ok) / count(*) acc_a, sum(y.ok) / count(*) acc_b, cast(sum(x.ok * (1 - y.ok)) as bigint) b, cast(sum((1 - x.ok) * y.ok) as bigint) c from r x join r y on x.pipeline = y.pipeline and x.mode = y.mode and x.row_id = y.row_id and x.cfg < y.cfg group by all),
{_TESTS}, {_holm("pipeline, mode", "a, b_name")}"""
_ACROSS = f""", r as (select pipeline, mode, emb, clf, row_id, {_RIGHT} ok from preds),
counted as (select x.pipeline, x.emb, x.clf, x.mode a, y.mode b_name, sum(x.ok) / count(*) acc_a, sum(y.ok) / count(*) acc_b, cast(sum(x.ok * (1 - y.ok)) as bigint) b, cast(sum((1 - x.ok) * y.ok) as bigint) c from r x join r y on x.pipeline = y.pipeline and x.emb = y.emb and x.clf = y.clf and x.row_id = y.row_id and x.mode < y.mode group by all),
{_TESTS}, {_holm("pipeline", "emb, clf, a, b_name")}"""
_DEG = ", ".join(f"round(r.{m} - v.{m}, 9) deg_{m}" for m in ("accuracy", '"precision"', "recall", "f1", "roc_auc", "pr_auc")).replace('deg_"precision"', "deg_precision")
_DEGRADED = f"degraded as (select r.pipeline, r.emb, r.clf, r.mode reference, v.mode variant, {_DEG} from results r join results v using (pipeline, emb, clf) where r.mode <> v.mode)"
_PIVOT = ", ".join(f"max(case when mode = '{m}' then {c} end) {m}_{c}" for m in ("normal", "user_intent_only", "context_only") for c in ("roc_auc", "accuracy"))
_POOL = "pool as (select case when item_id % 3 = 0 then 'code' else 'text' end kind, case when item_id % 8 % 2 = 0 then 'train' else 'test' end part, 'cat' || (item_id % 8) category, text instruction, item_id from benchmark)"


def _md5(key: str) -> str:
    return f"md5('{SEED}:' || {key})"


def _number(key: str, at: int) -> str:
    return f"cast('0x' || substr({_md5(key)}, {at}, 8) as bigint)"


_ASSIGNED = f"""{_POOL}, numbered as (select *, row_number() over (partition by kind, part order by item_id) pick, count(*) over (partition by kind, part) size from pool),
d as (select doc_id, text, case when doc_id % 3 = 0 then 'code' else 'text' end kind, case when doc_id % 5 = 0 then 'test' else 'train' end part from documents),
assigned as (select d.*, n.category attack_category, n.instruction from d join (select distinct kind, part, size from numbered) z using (kind, part) join numbered n on n.kind = d.kind and n.part = d.part and n.pick = {_number("doc_id", 1)} % z.size + 1),
placed as (select *, (['start','middle','end'])[{_number("doc_id", 9)} % 3 + 1] pos from assigned)"""
_FIRST = "ranked as (select *, row_number() over (partition by text order by doc_id) copy from documents)"

ORACLES = {
    "detection_metrics": f"{_METRICS} select * from results",
    "best_configuration": f"{_METRICS} select pipeline, mode, emb, clf, roc_auc, accuracy from results order by roc_auc desc, pipeline, mode, emb, clf limit 1",
    "top_k_preview": f"{_METRICS} select pipeline, mode, emb, clf, roc_auc, accuracy, f1 from results order by roc_auc desc, pipeline, mode, emb, clf limit 6",
    "roc_curve": f"""{_RUN}, k as (select emb, clf, cast(score as double) score, fp / n fpr, tp / p tpr from c where np is null or np <> pos or nn <> neg union all select distinct emb, clf, 9.0, 0.0, 0.0 from c)
 select emb, clf, cast(row_number() over (partition by emb, clf order by score desc) - 1 as int) point, round(fpr, 9) fpr, round(tpr, 9) tpr from k""",
    "pr_curve": f'{_RUN} select emb, clf, cast(point as int) point, round(recall, 9) recall, round("precision", 9) "precision" from pr',
    "pr_auc_trapz": f'{_RUN} select emb, clf, round(sum(abs(recall - r0) * ("precision" + p0) / 2), 6) area from (select *, lag(recall) over w r0, lag("precision") over w p0 from pr window w as (partition by emb, clf order by point)) group by all',
    "curve_downsample": f"""{_RUN}, z as (select *, count(*) over (partition by emb, clf) n from pr)
 select emb, clf, cast(point as int) point, round(recall, 9) recall, round("precision", 9) "precision" from z where n <= 250 or list_contains(list_transform(range(0, 250), lambda i: cast(floor(i * ((n - 1) / 249.0) + 1e-9) as int)), cast(point as int))""",
    "score_histogram": f"with {PREDS_SQL} select pipeline, mode, emb, clf, cast(least(floor(cast(y_prob as double) * 200), 199) as int) bin, cast(sum(1 - y_true) as bigint) n_benign, cast(sum(y_true) as bigint) n_malicious from preds group by all",
    "breakdown_by_group": f"""with {PREDS_SQL} select p.pipeline, p.mode, p.emb, p.clf, e.event_type category, count(*) n, cast(sum(y_true) as bigint) n_malicious, round(avg({_RIGHT}), 9) accuracy, round(sum(y_true * y_pred) / nullif(sum(y_true), 0), 9) detection_rate, round(sum((1 - y_true) * y_pred) / nullif(sum(1 - y_true), 0), 9) fpr
 from preds p join events e on e.event_id = p.row_id where e.event_type <> 'click' group by all""",
    "mcnemar_within": f"{_WITHIN} select pipeline, mode, a, b_name, {_TEST_COLUMNS} from holm",
    "ablation_mcnemar": f"with {PREDS_SQL}{_ACROSS} select pipeline, emb, clf, a, b_name, {_TEST_COLUMNS} from holm",
    "mode_alignment": f"with {PREDS_SQL} select pipeline, mode, count(distinct row_id) n_rows, true aligned from preds group by all",
    "ablation_degradation": f"{_METRICS}, {_DEGRADED} select * from degraded",
    "degradation_headline": f"{_METRICS}, {_DEGRADED} select reference, variant, " + ", ".join(f"round(avg(deg_{m}) * 100, 2) mean_{m}_pp" for m in ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")) + " from degraded group by all",
    "master_table": f"""{_METRICS}{_ACROSS}, w as (select pipeline, emb, clf, {_PIVOT} from results group by all)
 select w.*, round(normal_roc_auc - user_intent_only_roc_auc, 9) user_intent_only_deg, round(i.p_holm, 9) user_intent_only_p, i.p_holm < 0.05 user_intent_only_significant, round(normal_roc_auc - context_only_roc_auc, 9) context_only_deg, round(x.p_holm, 9) context_only_p, x.p_holm < 0.05 context_only_significant
 from w left join holm i on i.pipeline = w.pipeline and i.emb = w.emb and i.clf = w.clf and i.a = 'normal' and i.b_name = 'user_intent_only' left join holm x on x.pipeline = w.pipeline and x.emb = w.emb and x.clf = w.clf and x.a = 'context_only' and x.b_name = 'normal'""",
    "shortcut_flags": f"{_METRICS}, w as (select pipeline, emb, clf, {_PIVOT} from results group by all) select pipeline, emb, clf, user_intent_only_roc_auc intent_auc, round(normal_roc_auc - user_intent_only_roc_auc, 9) degradation, user_intent_only_roc_auc >= 0.99 or normal_roc_auc - user_intent_only_roc_auc <= 0 shortcut from w",
    "pipeline_verdict": f"""{_METRICS}, b as (select *, row_number() over (partition by pipeline, mode order by roc_auc desc, emb, clf) k from results),
 o as (select pipeline, max(case when mode = 'normal' then roc_auc end) normal_auc, max(case when mode = 'normal' then accuracy end) normal_accuracy, max(case when mode = 'user_intent_only' then roc_auc end) intent_auc, max(case when mode = 'context_only' then roc_auc end) context_auc from b where k = 1 group by 1)
 select *, case when intent_auc >= 0.9 then 'shortcut' when intent_auc <= 0.6 and normal_auc >= 0.8 then 'detects' else 'inconclusive' end verdict from o""",
    "best_classifier": f"{_METRICS} select pipeline, emb, clf, roc_auc from results where mode = 'normal' qualify row_number() over (partition by pipeline, emb order by roc_auc desc, clf) = 1",
    "ablation_groups": f"{_METRICS}, b as (select pipeline, emb, clf from results where mode = 'normal' qualify row_number() over (partition by pipeline, emb order by roc_auc desc, clf) = 1) select pipeline, emb, clf, " + ", ".join(f"max(case when mode = '{m}' then roc_auc end) {m}" for m in ("normal", "user_intent_only", "context_only")) + " from results join b using (pipeline, emb, clf) group by all",
    "metric_heatmap": f"{_METRICS} select pipeline, clf, " + ", ".join(f"max(case when emb = '{e}' then accuracy end) {e}" for e in ("minilm", "openai", "qwen3")) + " from results where mode = 'normal' group by all",
    "filtered_view": f"""{_METRICS}, b as (select pipeline, emb, clf from results where mode = 'normal' qualify row_number() over (partition by pipeline, emb order by roc_auc desc, clf) = 1)
 select r.pipeline, r.mode, r.emb, r.clf, r.roc_auc, b.clf is not null best, count(*) over () shown, (select count(*) from results) total from results r left join b using (pipeline, emb, clf) where r.pipeline in (1, 2) and r.mode in ('normal', 'context_only') and r.emb in ('minilm', 'openai') and r.clf in ('SVM', 'XGBoost')""",
    "usable_documents": r"select doc_id, cast(length(text) as int) n from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) between 200 and 6000",
    "prefix_truncation": r"select doc_id, md5(substr(regexp_replace(text, '^\s+|\s+$', '', 'g'), 1, 6000)) prefix_md5 from documents",
    "first_occurrence": f"with {_FIRST} select doc_id, cast(copy as int) copy from ranked",
    "topup_pool": f"with {_FIRST} select doc_id, cast(copy as int) copy from ranked order by copy > 1, doc_id limit 950",
    "template_cycle": f"with {_FIRST} select doc_id, cast(coalesce(sum(case when copy = 1 then 1 else 0 end) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) % 5 as int) template from ranked",
    "attack_pool_strict": f"with {_POOL} select kind, part, category, item_id from pool where part = 'train' or (kind, category) not in (select kind, category from pool where part = 'train')",
    "attack_assignment": f"with {_ASSIGNED} select doc_id, kind, part, attack_category, md5(instruction) instruction_md5 from placed",
    "twin_build": f"""with {_ASSIGNED} select doc_id, 0 as label, null::varchar injection_position, null::varchar attack_category, cast(length(text) as int) n from placed union all select doc_id, 1, pos, attack_category, cast(case when pos = 'middle' then 2 else 1 end + length(text) + length(instruction) as int) from placed""",
    "insert_start_end": f"with {_ASSIGNED} select doc_id, pos injection_position, md5(case when pos = 'start' then instruction || chr(10) || text else text || chr(10) || instruction end) context_md5 from placed where pos <> 'middle'",
    "grouped_split": f"with t as (select text, row_number() over (order by {_md5('text')}, text) k, count(*) over () n from (select distinct text from documents)) select doc_id, case when k <= round_even(n * 0.8, 0) then 'train' else 'test' end split from documents join t using (text)",
    "stratified_split": f"select doc_id, toxic, case when row_number() over (partition by toxic order by {_md5('doc_id')}, doc_id) <= round_even(count(*) over (partition by toxic) * 0.2, 0) then 'test' else 'train' end split from labels where toxic is not null",
    "balance_pool": f"with r as (select doc_id, case when toxic = 0 then 1 else 0 end as label from labels where toxic is not null) select doc_id, label from r where label = 0 union all (select doc_id, label from r where label = 1 order by {_md5('doc_id')}, doc_id limit (select count(*) from r where label = 0))",
    "label_stats": "select lang, count(*) n, count(distinct text) n_texts, cast(coalesce(sum(toxic), 0) as bigint) n_toxic, round(avg(toxic), 9) toxic_share from documents left join labels using (doc_id) group by lang",
    "split_overlap": f"with {_POOL}, c as (select kind, category, max(case when part = 'train' then 1 else 0 end) a, max(case when part = 'test' then 1 else 0 end) b from pool group by all) select kind, cast(sum(a) as bigint) n_train, cast(sum(b) as bigint) n_test, cast(sum(a * b) as bigint) n_both from c group by kind",
    "flatten_table": "select n_regionkey, string_agg(lpad(cast(n_nationkey as varchar), 3, '0') || ' | ' || n_name, chr(10) order by n_nationkey) flat from nation group by 1",
    "selected_passage": "select n_regionkey, coalesce(min_by(case when n_nationkey % 4 = 2 then n_name end, case when n_nationkey % 4 = 2 then n_nationkey end), min_by(n_name, n_nationkey)) passage from nation group by 1",
    "compose_mode_text": r"""with f as (select conv_id, min_by(text, turn) intent from conversations where role = 'user' group by 1), j as (select doc_id, coalesce(text, 'None') c, coalesce(intent, 'None') i from documents left join f on conv_id = doc_id)
 select doc_id, md5(c || chr(10) || chr(10) || '---' || chr(10) || chr(10) || i) normal, md5(case when regexp_matches(i, '^\s*$') then ' ' else i end) user_intent_only, md5(case when regexp_matches(c, '^\s*$') then ' ' else c end) context_only from j""",
    "pii_audit_checked": "with p(label, kind, re) as (values ('''intended recipient''', 'residue', '(?i)intended\\s+recipient'), ('''received in error''', 'residue', '(?i)received\\s+this\\s+in\\s+error'), ('confidentiality wording', 'residue', '(?i)confidential'), ('''Forwarded by''', 'residue', '(?i)forwarded\\s+by'), ('attachment stub', 'residue', '<<[^<>\\n]{1,160}>>'), ('SSN-shaped', 'identifier', '\\b\\d{3}-\\d{2}-\\d{4}\\b')), h as (select label, kind, len(regexp_extract_all(coalesce(text, ''), re)) n from documents cross join p) select label, kind, cast(sum(case when n > 0 then 1 else 0 end) as bigint) n_rows, cast(sum(n) as bigint) n_hits from h group by all",
    "luhn_cards": r"""with h as (select doc_id, unnest(regexp_extract_all(text, '\b(?:\d{4}[-\s]?){3}\d{4}\b')) card from documents), g as (select doc_id, list_reverse(list_transform(string_split(regexp_replace(card, '[^0-9]', '', 'g'), ''), lambda x: cast(x as int))) d from h)
 select doc_id, count(*) n_shaped, cast(sum(case when list_sum(list_transform(d, lambda x, i: case when i % 2 = 1 then x when x > 4 then 2 * x - 9 else 2 * x end)) % 10 = 0 then 1 else 0 end) as bigint) n_valid from g group by 1""",
    "span_merge": """with e as (select user_id, event_id seq, cast(event_id * 37 % 200 as int) s, event_type kind, (event_id % 5) / 10.0 score, event_id % 7 as m from events), x as (select *, cast(s + 1 + m as int) e from e),
 r as (select *, row_number() over w rk, max(e) over (w rows between unbounded preceding and 1 preceding) reach from x window w as (partition by user_id order by s, e desc, seq)),
 i as (select *, sum(case when reach is null or s >= reach then 1 else 0 end) over (partition by user_id order by rk) island from r), k as (select *, row_number() over (partition by user_id, island order by score desc, rk) best from i)
 select user_id, min(s) "start", max(e) "end", max(case when best = 1 then kind end) kind from k group by user_id, island""",
    "rolling_token_budget": "select event_id, cast(sum(event_id % 97) over (partition by user_id order by epoch_us(ts) range between 3599999999 preceding and current row) as bigint) spent from events",
    "latency_percentiles": "select event_type, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(min(value), 6) least from events group by 1",
    "reservoir_sample": f"select conv_id, turn, role from conversations order by {_md5("(conv_id || '-' || turn)")}, conv_id || '-' || turn limit 25",
    "log_state": """with s as (select user_id job, count(*) step, max_by(event_type, event_id) "label", max(event_id) since from events where event_id % 11 = 0 group by 1), p as (select user_id job, max_by('p' || (event_id % 7), event_id) phase from events join s on s.job = user_id where event_id % 11 <> 0 and event_id % 3 = 0 and event_id > since group by 1) select job, step, "label", phase from s left join p using (job)""",
    "pipeline_artifacts": "with g as (select cast(p as int) pipeline, mode from (values (1),(2),(3),(4)) a(p) cross join (values ('normal'),('user_intent_only'),('context_only')) m(mode)), e as (select distinct cast(1 + user_id % 3 as int) pipeline, 1 here from events) select g.pipeline, mode, count(*) n_expected, cast(coalesce(sum(here), 0) as bigint) n_present from g left join e using (pipeline) group by rollup (g.pipeline, mode)",
}

_BOUNDS = ", ".join(f"({i}, '{name}', {low}, {high})" for i, (name, (low, high)) in enumerate(sorted(BOUNDS.items())))


def _all_runs(sql: str) -> str:
    """The SQL of one run's curves, over every run."""
    own = sql.replace(PREDS_SQL, "@").replace(" where pipeline = 1 and mode = 'normal'", "").replace("emb, clf", "pipeline, mode, emb, clf")
    return own.replace("@", PREDS_SQL)


ORACLES |= {f"{name}_all_runs": _all_runs(ORACLES[name]) for name in ("roc_curve", "pr_curve", "pr_auc_trapz", "curve_downsample")}
ORACLES |= {
    "confusion_rates": f"{_METRICS} select pipeline, mode, emb, clf, round(tn / greatest(tn + fp, 1), 9) tn_rate, round(fp / greatest(tn + fp, 1), 9) fp_rate, round(fn / greatest(fn + tp, 1), 9) fn_rate, round(tp / greatest(fn + tp, 1), 9) tp_rate from results",
    "degradation_cells": f"""with m as ({ORACLES["master_table"]}) select pipeline, emb, clf,
      case when user_intent_only_deg * 100 > 0.5 then 'pos' else 'alarm' end || case when coalesce(user_intent_only_significant, true) then '' else ' ns' end user_intent_only_class,
      case when context_only_deg * 100 > 0.5 then 'pos' else 'flat' end || case when coalesce(context_only_significant, true) then '' else ' ns' end context_only_class from m""",
    "trained_subset": f"""with {PREDS_SQL}, have as (select distinct pipeline, mode, emb from preds),
      wanted as (select p.pipeline, m.mode, e.emb from (values (1), (2), (3), (4)) p(pipeline), (values ('normal'), ('user_intent_only'), ('context_only')) m(mode), (values ('minilm'), ('openai'), ('qwen3')) e(emb))
      select w.pipeline, w.mode, coalesce(string_agg(case when h.emb is null then w.emb end, ',' order by w.emb), '') missing, count(*) = count(h.emb) complete from wanted w left join have h on h.pipeline = w.pipeline and h.mode = w.mode and h.emb = w.emb group by w.pipeline, w.mode""",
    "cost_summary": "select event_type, round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) median, round(max(value), 6) most from events group by event_type",
    "embedding_plan": r"""with t as (select lang, coalesce(len(regexp_extract_all(text, '\S+')), 0) n from documents)
      select lang, count(*) n_texts, cast(sum(least(greatest(n, 1), 8191)) as bigint) n_tokens, cast(sum(case when n > 8191 then 1 else 0 end) as bigint) n_truncated, round(sum(least(greatest(n, 1), 8191)) / 850000.0, 9) as minutes from t group by lang""",
    "usable_by_source": rf"""select doc_id, kind from documents join (values {_BOUNDS}) b(place, kind, low, high) on doc_id % {len(BOUNDS)} = place
      where length(text) > 0 and length(regexp_replace(text, '^\s+|\s+$', '', 'g')) between low and high""",
    "renumbered_ids": "select doc_id, format('aeslc_{:05d}', row_number() over (order by doc_id) - 1) new_id from (select min(doc_id) doc_id from documents group by text)",
    "job_progress": """with j as (select user_id, count(*) total, count(*) filter (event_type = 'click') done, epoch(date_trunc('second', max(ts))) - epoch(date_trunc('second', min(ts))) elapsed from events group by user_id),
      f as (select user_id, elapsed, least(1.0, (greatest(0, user_id % 20 - 1) + done / total) / 19) fraction from j)
      select user_id, round(fraction, 9) fraction, cast(case when fraction > 0.02 then floor(elapsed * (1 - fraction) / fraction + 0.5) end as bigint) seconds_left from f""",
    "upload_guard": r"""select doc_id, case when doc_id % 3 = 2 then 'type' when strlen(text) > 1048576 then 'size' when regexp_matches(text, '[\x00-\x08\x0e-\x1f]') then 'binary' when coalesce(length(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), 0) = 0 then 'empty' else 'ok' end verdict from documents""",
    "dataset_peek": "select doc_id, md5(case when length(text) > 110 then substr(text, 1, 110) || '…' else text end) short_md5, md5(case when length(text) > 170 then substr(text, 1, 170) || '…' else text end) long_md5 from documents",
}

_SPOILED = PREDS_SQL.replace("preds as (", "every_pred as (") + """,
preds as (select * from every_pred where not (pipeline = 2 and mode = 'context_only' and row_id % 10 = 0) and not (pipeline = 3 and mode = 'user_intent_only'))"""
_ALIGNED = _SPOILED.replace("row_id % 10 = 0", "true")
_SPOILED_METRICS, _ALIGNED_METRICS = _METRICS.replace(PREDS_SQL, _SPOILED), _METRICS.replace(PREDS_SQL, _ALIGNED)
_QUALITY = ("accuracy", "precision", "recall", "f1", "roc_auc", "pr_auc")
_MODE_ORDER = ("normal", "user_intent_only", "context_only")


def _comparison(reference: str) -> str:
    variants = [m for m in _MODE_ORDER if m != reference]
    wide = ", ".join(f"max(case when mode = '{m}' then \"{c}\" end) {m}_{c}" for m in (reference, *variants) for c in _QUALITY)
    tests = f"with {_ALIGNED}{_ACROSS} select pipeline, emb, clf, a, b_name, round(p_holm, 9) p, p_holm < 0.05 significant, b, c from holm"
    more = ", ".join(", ".join([*[f"round({reference}_{c} - {v}_{c}, 9) {v}_deg_{c}" for c in _QUALITY], *[f"t{i}.{c} {v}_{c}" for c in ("p", "significant", "b", "c")]]) for i, v in enumerate(variants))
    joins = " ".join(f"left join t t{i} on t{i}.pipeline = w.pipeline and t{i}.emb = w.emb and t{i}.clf = w.clf and t{i}.a = '{min(reference, v)}' and t{i}.b_name = '{max(reference, v)}'" for i, v in enumerate(variants))
    flag = "coalesce(user_intent_only_roc_auc >= 0.99 or normal_roc_auc - user_intent_only_roc_auc <= 0, false)" if reference == "normal" else "false"
    return f"with m as ({_SPOILED_METRICS} select * from results), t as ({tests}), w as (select pipeline, emb, clf, {wide} from m group by all having count(*) filter (mode = '{reference}') > 0) select w.*, {more}, {flag} shortcut from w {joins}"


ORACLES |= {
    "alignment_spoiled": f"with {_SPOILED} select pipeline, mode, count(distinct row_id) n_rows, not (pipeline = 2 and mode = 'context_only') aligned from preds group by all",
    "ablation_mcnemar_spoiled": f"with {_ALIGNED}{_ACROSS} select pipeline, emb, clf, a, b_name, {_TEST_COLUMNS} from holm",
    "ablation_degradation_spoiled": f"{_ALIGNED_METRICS}, {_DEGRADED} select * from degraded",
    "comparison_normal": _comparison("normal"),
    "comparison_intent": _comparison("user_intent_only"),
    "comparison_notes": f"{_SPOILED_METRICS}, h as (select pipeline, emb, clf, count(*) filter (mode = 'user_intent_only') n from results group by all) select 'no reference' note, count(*) n from h where n = 0 union all select 'no tests', 0",
    "ablation_groups_all": f"{_METRICS} select pipeline, emb, clf, " + ", ".join(f"max(case when mode = '{m}' then roc_auc end) {m}" for m in _MODE_ORDER) + " from results group by all",
    "source_rows": "select doc_id, lang, source, n_chars from documents where source = 'src0'",
    "filled_rows": r"""with f as (select conv_id, min_by(text, turn) intent from conversations where role = 'user' group by 1)
      select doc_id from documents join f on conv_id = doc_id where regexp_matches(text, '\S') and regexp_matches(intent, '\S')""",
    "per_sample_ms": "select event_type, round(sum(value) / count(*) * 1000, 6) ms from events group by 1",
    "without_empty": f"{_METRICS} select pipeline, mode, emb, clf, accuracy from results",
    "capabilities": f"{_METRICS} select pipeline, count(distinct mode) n_modes, count(*) n_results, count(roc_auc) n_auc, count(fpr) n_fpr from results group by 1",
    "axis_range": f"{_METRICS} select mode, min(roc_auc) low, max(roc_auc) high, count(roc_auc) n from results group by 1",
    "group_separators": f"{_METRICS} select pipeline, emb, clf, roc_auc, coalesce(lag(emb) over (order by pipeline, emb, clf) <> emb, true) opens from results where mode = 'normal'",
    "degradation_order": f"{_METRICS}, {_DEGRADED} select pipeline, emb, clf, reference, variant, deg_roc_auc, cast(row_number() over (order by reference, variant, deg_roc_auc desc, pipeline, emb, clf) as int) place from degraded",
    "configuration_order": f"{_METRICS}, o as (select pipeline, emb, clf, cast(case pipeline when 3 then 0 when 1 then 1 else 99 end as int) ordinal from results where mode = 'normal') select *, cast(row_number() over (order by ordinal, pipeline, emb, clf) as int) place from o",
    "sorted_in_pipelines": f"{_METRICS} select pipeline, mode, emb, clf, f1, cast(row_number() over (partition by pipeline order by f1 desc nulls last, pipeline, mode, emb, clf) as int) place from results",
    "candidate_rows": f"select doc_id from documents order by {_md5('doc_id')}, doc_id limit 170",
    "breakdown_order": "with e as (select event_type, count(*) n, min(event_id) first_row from events group by 1) select *, cast(row_number() over (order by n desc, first_row) as int) place from e",
    "merged_attack_pool": f"with {_POOL} select kind, category, count(*) n from pool group by all",
    "configuration_keys": f"with {PREDS_SQL} select distinct emb || '__' || clf || '__' || mode || '__x' as name, upper(emb) emb, clf || '__' || mode || '__x' as rest from preds",
    "normal_paths": """with w as (select page_id, split_part(url, '#', 1) u from pages), q as (select page_id, split_part(u, '?', 1) base, case when contains(u, '?') then substr(u, position('?' in u) + 1) else '' end q from w)
      select page_id, case when q = '' then base else base || '?' || array_to_string(list_sort(string_split(q, '&')), '&') end as path from q""",
    "stamps": "select event_id, strftime(ts, '%Y-%m-%d %H:%M') stamp from events",
    "latency_draws": f"""with p as (select vec_id, row_number() over (order by {_md5('vec_id')}, vec_id) - 1 k from embeddings), q as (select *, count(*) over () pool from p where k < 3520),
      d as (select range draw, cast('0x' || substr(md5('{SEED + 1}:' || range), 1, 8) as bigint) r from range(220)) select draw, draw < 20 warm, vec_id from d join q on r % pool = k""",
    "projection_sample": f"select event_id from events order by {_md5('event_id')}, event_id limit 5000",
    "rows_to_embed": "select doc_id from documents where doc_id not in (select vec_id from embeddings)",
    "vectors_of_rows": "select doc_id, lang, cast(len(embedding) as int) dim, label from documents join embeddings on vec_id = doc_id",
    "twin_counts": f"with {_ASSIGNED} select pos as position, count(distinct doc_id) n_documents, count(*) n_injected, 0 as n_clean from placed group by 1 union all select 'none', count(distinct doc_id), 0, count(*) from placed",
    "rows_without_group": f"with {PREDS_SQL} select pipeline, mode, emb, clf, count(*) filter (event_type = 'click') n_without, count(*) n from preds join events on event_id = row_id group by all",
    "request_totals": r"with t as (select sum(greatest(coalesce(len(regexp_extract_all(text, '\S+')), 0), 1))::bigint n_tokens from documents) select n_tokens, ceil(n_tokens / 100000)::bigint n_batches, round(n_tokens / 850000.0, 9) as minutes from t",
    "trained_groups": "select doc_id, text in (select text from documents where doc_id % 4 = 0) trained from documents",
    "listing_print": """with r as (select md5(event_id || '|' || coalesce(event_type, '')) h from events), w as (select count(*) n, """ + ", ".join(f"cast(sum(cast('0x' || substr(h, {1 + 8 * i}, 8) as bigint)) as varchar) w{i}" for i in range(4)) + """ from r)
      select n, md5(concat_ws('|', n, w0, w1, w2, w3)) print from w""",
    "tree_counts": "with g as (select cast(p as int) pipeline, mode from (values (1),(2),(3),(4)) a(p) cross join (values ('normal'),('user_intent_only'),('context_only')) m(mode)), e as (select distinct cast(1 + user_id % 3 as int) pipeline from events) select g.pipeline, mode, count(*) n_expected, count(e.pipeline) n_present, cast(count(e.pipeline) * 3 as bigint) n_files from g left join e using (pipeline) group by rollup (g.pipeline, mode)",
    "token_batches": r"""with recursive t as (select doc_id % 8 shard, coalesce(len(regexp_extract_all(text, '\S+')), 0) k, row_number() over (partition by doc_id % 8 order by doc_id) i from documents),
      r as (select shard, i, 0 batch, 1 n, k::bigint t from t where i = 1
        union all select t.shard, t.i, case when r.t + k > 5000 or r.n >= 64 then batch + 1 else batch end, case when r.t + k > 5000 or r.n >= 64 then 1 else r.n + 1 end, case when r.t + k > 5000 or r.n >= 64 then k else r.t + k end from r join t on t.shard = r.shard and t.i = r.i + 1)
      select shard, cast(batch as int) batch, cast(max(n) as int) n_texts, cast(max(t) as bigint) n_tokens from r group by all""",
    "insert_middle": f"""with {_ASSIGNED}, s as (select doc_id, text, instruction, string_split(regexp_replace(text, '([.!?])(\\s)', '\\1' || chr(1) || '\\2', 'g'), chr(1)) parts, {_number("doc_id", 17)} r from placed where pos = 'middle'),
      k as (select *, (r % len(parts))::int k from s),
      a as (select *, coalesce(list_sum(list_transform(parts[1:k], lambda p: length(p))), 0)::bigint + case when k > 0 then length(regexp_extract(parts[k + 1], '^\\s*')) else 0 end spot from k),
      o as (select doc_id, case when regexp_matches(text, '\\S') then substr(text, 1, spot) || chr(10) || instruction || chr(10) || substr(text, spot + 1) else text || chr(10) || instruction end context from a)
      select doc_id, md5(context) context_md5, length(context)::int n from o""",
    "usable_mails": r"""with f as (select conv_id, arg_min(text, turn) subject from conversations where role = 'user' group by 1), m as (select doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') t, trim(subject, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') s from documents left join f on conv_id = doc_id)
      select doc_id, md5(t) text_md5, length(s)::int n_subject from m where length(t) between 200 and 5000 and length(s) >= 3""",
    "usable_articles": r"""with m as (select doc_id, substr(trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '), 1, 6000) t from documents)
      select doc_id, md5(t) text_md5, length(t)::int n from m where length(trim(t, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ')) between 200 and 6000""",
    "usable_questions": r"""with f as (select conv_id, arg_min(text, turn) subject from conversations where role = 'user' group by 1), m as (select doc_id, trim(text, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') t, trim(subject, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') s from documents join f on conv_id = doc_id)
      select doc_id, md5(s) question_md5 from m where length(t) between 150 and 6000 and length(s) > 0""",
    "breakdown_columns": "select source, toxic as label, count(*) n from documents join labels using (doc_id) group by all",
    "unpaired_vectors": "select 'no vector' side, doc_id row_id from documents where doc_id not in (select vec_id from embeddings) union all select 'no row', vec_id from embeddings where vec_id not in (select doc_id from documents)",
    "latency_figures": "select round(avg(value), 6) mean, round(quantile_cont(value, 0.5), 6) p50, round(quantile_cont(value, 0.95), 6) p95, round(quantile_cont(value, 0.99), 6) p99, round(min(value), 6) least, count(value) n from events",
}
