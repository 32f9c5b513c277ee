"""Registered queries: each operator over inputs derived from the test tables."""

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions import types
from plumbline.functions.names import normalize_field_name
from plumbline.functions.text import fallback, fixed
from plumbline.operators import (
    dependencies,
    entity_matching,
    gaps,
    predicates,
    quality,
    remediation,
    runs,
    schema_exact,
    schema_fuzzy,
    scoring,
    sketches,
)
from plumbline.operators import requests as req
from plumbline.operators.similar_names import candidate_pairs, score_pairs
from plumbline.plans import inputs as i
from plumbline.plans.assessment import assess, assess_exact
from plumbline.sources import catalog as cat
from plumbline.sources import reads, results
from plumbline.sources.folders import stored, working_folder
from plumbline.streaming import events as stream_events
from plumbline.streaming import stateful
from plumbline.streaming.tables import append_available, parquet_stream, update_available

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
PAIR = schema_fuzzy.PAIR


def query(build: Callable[[SparkSession, str], DataFrame]):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        # Test tables hold zone-less times that stand for UTC.
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return build


def _time_text(name):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def _with_time_text(df, *names):
    return df.withColumns({name: _time_text(name) for name in names})


# --- sources and sinks ---------------------------------------------------------------


@query
def catalog_scan(spark, d):
    described = cat.described_catalog(i.tables(spark, d), "lake")
    return described.select("system", "entity", "field", "field_ord", "type", "row_count")


def _views(spark, d):
    return {
        "columns": i.derive(spark, d, i.INFORMATION_COLUMNS),
        "constraints": i.derive(spark, d, i.CONSTRAINTS),
        "key_columns": i.derive(spark, d, i.KEY_COLUMNS),
        "referenced_columns": i.derive(spark, d, i.REFERENCED_COLUMNS),
    }


@query
def catalog_pk(spark, d):
    return cat.catalog_from_information_schema(_views(spark, d)).select("system", "entity", "field", "nullable", "pk")


@query
def catalog_fk(spark, d):
    return cat.catalog_from_information_schema(_views(spark, d)).select("system", "entity", "field", "fk_to")


@query
def catalog_upper(spark, d):
    upper = cat.upper_case_names(cat.described_catalog(i.tables(spark, d), "warehouse"))
    return upper.select("system", "entity", "field", "field_ord", "type", "pk", "fk_to", "row_count")


@query
def catalog_from_describe(spark, d):
    catalog = cat.catalog_from_describe(cat.parse_describe(i.describe_documents(spark, d)))
    return catalog.select(
        "system", "system_ord", "entity", "field", F.coalesce("field_ord", F.lit(-1)).alias("field_ord"), "type",
        F.col("nullable").cast("string").alias("nullable"), F.col("pk").cast("string").alias("pk"), "fk_to",
        "label", F.coalesce("length", F.lit(-1)).alias("length"), F.col("createable").cast("string").alias("createable"),
        F.col("updateable").cast("string").alias("updateable"),
    )


@query
def filtered_scan(spark, d):
    wanted = [("o_orderstatus", "in", ["F", "O"]), ("o_totalprice", ">=", 150000.0), ("o_orderpriority", "!=", "5-LOW"), ("o_custkey", "is", "known")]
    return reads.filtered_scan(i.table(spark, d, "orders"), wanted, ["o_orderkey", "o_custkey", "o_orderstatus"])


@query
def read_query(spark, d):
    sql = (
        "SELECT o_orderpriority, o_orderstatus, count(*) AS n, min(o_orderkey) AS first_key, 0 AS attributes "
        "FROM {orders} GROUP BY o_orderpriority, o_orderstatus"
    )
    return reads.read_query(spark, sql, {"orders": i.table(spark, d, "orders")})


@query
def system_size(spark, d):
    return cat.system_size(cat.table_sizes(i.tables(spark, d), "lake"))


@query
def table_stats(spark, d):
    return cat.table_stats(cat.table_sizes(i.tables(spark, d), "lake"))


@query
def sample_rows(spark, d):
    return reads.sample_rows(i.table(spark, d, "customer"), ["c_custkey"], 1000)


@query
def report_json(spark, d):
    t = _finding_tables(spark, d, stored)
    effort = remediation.remediation_effort(remediation.plan_items(*_issues(t)))
    summary = remediation.findings_summary(*_issues(t))
    documents = results.report_documents(_readiness(t, _run_list(spark, d)), summary, effort, "2024-01-31")
    schema = (
        "run_id bigint, readiness_score double, verdict string, findings_summary struct<schema_inconsistencies:bigint,"
        "middleware_gaps:bigint>, remediation_items bigint, total_effort_max_days bigint, remediation_weeks string"
    )
    r = F.from_json("report", schema)
    return documents.select(r.alias("r")).select(
        "r.run_id",
        "r.readiness_score",
        "r.verdict",
        "r.findings_summary.schema_inconsistencies",
        "r.findings_summary.middleware_gaps",
        "r.remediation_items",
        "r.total_effort_max_days",
        "r.remediation_weeks",
    )


@query
def finding_tables(spark, d):
    path = working_folder(spark, "schema_findings")
    table = results.TABLES["schema_findings"]
    results.write_results(i.derive(spark, d, i.FINDINGS).select(*table.names), path)
    return results.read_results(spark, path, table)


# --- filters and projections ---------------------------------------------------------


@query
def readonly_audit(spark, d):
    log = i.derive(spark, d, i.STATEMENTS)
    return log.select("stmt_id", "user_id", "query", predicates.is_read_only(F.col("query")).alias("allowed"))


@query
def soql_audit(spark, d):
    log = i.derive(spark, d, i.STATEMENTS)
    return log.select("stmt_id", predicates.is_select(F.col("query")).alias("allowed"))


@query
def active_catalog(spark, d):
    systems = predicates.active(i.derive(spark, d, i.SYSTEMS))
    return systems.select("run_id", "name", "type")


@query
def entities_requested(spark, d):
    wanted = predicates.requested_entities(i.catalog(spark, d), i.derive(spark, d, i.WANTED_ENTITIES))
    return wanted.select("system", "entity", "field", "type")


@query
def critical_counts(spark, d):
    return predicates.critical_counts(i.derive(spark, d, i.FINDINGS), i.pipeline_bottlenecks(spark, d), i.gap_rows(spark, d))


@query
def findings_at_least(spark, d):
    listed = predicates.at_least(i.derive(spark, d, i.FINDINGS), "HIGH", ["input_ord"])
    return listed.select("run_id", "input_ord", "severity", "kind")


@query
def scenario_validate(spark, d):
    checked = predicates.validate_scenarios(i.derive(spark, d, i.SCENARIOS))
    return checked.select("run_id", F.array_join("failed_rules", ",").alias("failed_rules"), "valid")


@query
def unknown_refs(spark, d):
    registered = i.table(spark, d, "customer").filter("c_acctbal >= 0")
    return predicates.unknown_references(i.table(spark, d, "orders"), "o_custkey", registered, "c_custkey")


@query
def finding_view(spark, d):
    findings = i.derive(spark, d, i.FINDINGS).select(
        "run_id",
        F.col("input_ord").cast("string").alias("id"),
        F.col("entity_name").alias("entity"),
        "source_system",
        "kind",
        F.when(F.col("severity") != "INFO", F.col("severity")).alias("severity"),
        F.col("impact_description").alias("detail"),
    )
    return predicates.finding_view(findings)


@query
def gap_view(spark, d):
    whole = F.col("severity") != "LOW"
    rows = i.gap_rows(spark, d).withColumn("effort_max", F.when(whole, F.col("effort_max")))
    return predicates.gap_view(rows)


@query
def load_plan(spark, d):
    return predicates.load_plan(i.derive(spark, d, i.SCENARIOS))


# --- names, types, formats -----------------------------------------------------------


@query
def normalize_names(spark, d):
    fields = i.catalog(spark, d).select("field").distinct()
    words = i.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("field")).distinct()
    names = fields.union(words).distinct()
    return names.select("field", normalize_field_name(F.col("field")).alias("norm"))


@query
def type_base(spark, d):
    declared = i.catalog(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("fields"))
    return declared.select("type", types.type_base(F.col("type")).alias("base"), "fields")


def _type_pairs(spark, d):
    """Every pair of types that two systems declare for the same field position."""
    fields = i.catalog(spark, d).select("entity", "field_ord", "type", "system_ord")
    other = fields.select("entity", "field_ord", F.col("type").alias("other"), F.col("system_ord").alias("other_ord"))
    met = fields.join(other, ["entity", "field_ord"]).filter(F.col("system_ord") != F.col("other_ord"))
    return met.groupBy("type", "other").agg(F.count(F.lit(1)).alias("met"))


@query
def type_compat(spark, d):
    pairs = _type_pairs(spark, d)
    return pairs.select("type", "other", "met", types.types_compatible(F.col("type"), F.col("other")).alias("compatible"))


@query
def type_similarity(spark, d):
    a, b = F.col("type"), F.col("other")
    return _type_pairs(spark, d).select(
        "type", "other", "met", types.type_similarity(a, b).alias("similarity"), types.types_equivalent(a, b).alias("equivalent")
    )


@query
def name_similarity(spark, d):
    words = i.vocabulary_catalog(spark, d).select("entity", normalize_field_name(F.col("field")).alias("norm")).distinct()
    words = stored(words, "words")
    sources = words.withColumnRenamed("norm", "source_norm")
    targets = words.withColumnRenamed("norm", "target_norm")
    return score_pairs(candidate_pairs(sources, targets, 0.8, ["entity"]), 0.8)


@query
def enum_fallback(spark, d):
    domain = ["ERP", "CRM", "DATA_WAREHOUSE", "DATABASE"]
    systems = i.derive(spark, d, i.SYSTEMS)
    return systems.groupBy(F.col("type").alias("given"), fallback(F.col("type"), domain, "DATABASE").alias("system_type")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query
def py_round(spark, d):
    lines = i.table(spark, d, "lineitem")
    price = F.col("l_extendedprice")
    return lines.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        fixed(price, 0).alias("whole"),
        fixed(price / 7, 1).alias("tenths"),
        fixed(F.col("l_discount") * F.lit(12.5), 2).alias("hundredths"),
    )


@query
def json_roundtrip(spark, d):
    scenarios = i.derive(spark, d, i.SCENARIOS)
    scores = F.col("run_id") % 101
    rows = scenarios.select(
        "run_id",
        "name",
        "concurrent_users",
        "queries_per_minute",
        "peak_multiplier",
        "response_time_target_ms",
        F.lit(None).cast("string").alias("use_case"),
        F.when(scores > 9, scores.cast("double")).alias("score"),
        F.when(scores > 50, "GO").alias("verdict"),
        F.repeat(F.concat(F.col("name"), F.lit(" ")), 300).alias("executive_summary"),
    )
    return runs.unpack_run(runs.pack_run(rows))


# --- cross-system comparison ---------------------------------------------------------


def _compared(spark, d):
    return schema_fuzzy.compare_fields(i.catalog(spark, d), store=stored)


def _compared_words(spark, d):
    catalog = stored(i.vocabulary_catalog(spark, d), "word_catalog")
    return schema_fuzzy.compare_fields(catalog, store=stored)


@query
def entity_candidates(spark, d):
    catalog = stored(i.derive(spark, d, i.NAMED_ENTITIES), "named_entities")
    rows = catalog.groupBy("system", "entity").agg(F.sum("row_part").alias("row_count"))
    return entity_matching.entity_candidates(catalog, rows, store=stored)


@query
def shared_entities(spark, d):
    return schema_fuzzy.shared_entities(i.catalog(spark, d))


@query
def system_pairs(spark, d):
    return schema_fuzzy.system_pairs(i.catalog(spark, d))


@query
def exact_norm_match(spark, d):
    equal = schema_fuzzy.compare_fields(i.catalog(spark, d), None, stored)
    return schema_fuzzy.field_matches(equal).select(*PAIR, "source_field", "target_field", "score")


@query
def fuzzy_match(spark, d):
    return schema_fuzzy.field_matches(_compared_words(spark, d)).select(*PAIR, "source_field", "target_field", "score")


@query
def matched_type_mismatch(spark, d):
    return schema_fuzzy.matched_type_mismatches(_compared(spark, d))


@query
def missing_fields(spark, d):
    catalog = i.catalog(spark, d)
    found = schema_fuzzy.missing_fields(catalog, stored(schema_fuzzy.compare_fields(catalog, store=stored), "compared"))
    return found.select(*PAIR, "field", "side")


@query
def schema_similarity(spark, d):
    catalog = i.catalog(spark, d)
    return schema_fuzzy.schema_similarity(catalog, schema_fuzzy.compare_fields(catalog, store=stored))


@query
def key_mismatch(spark, d):
    return schema_fuzzy.key_mismatches(_compared(spark, d)).select(*PAIR)


@query
def inconsistency_report(spark, d):
    report = schema_fuzzy.inconsistency_report(stored(_compared(spark, d), "compared"), ordered=True)
    return report.select(*PAIR, "kind", "severity", "detail")


@query
def fuzzy_report(spark, d):
    report = schema_fuzzy.inconsistency_report(stored(_compared_words(spark, d), "compared"))
    return report.groupBy("entity", "kind", "severity").agg(F.count(F.lit(1)).alias("n"))


@query
def nullability_difference(spark, d):
    return schema_fuzzy.nullability_differences(_drifting(spark, d))


@query
def key_type_mismatch(spark, d):
    return schema_fuzzy.key_type_mismatches(_drifting(spark, d))


def _drifting(spark, d):
    """The catalog with key types and nullability that differ between systems."""
    fields = i.catalog(spark, d)
    odd = F.col("system_ord") % 2 == 1
    return schema_fuzzy.compare_fields(
        fields.withColumn("type", F.when(F.col("pk") & odd, "bigint").otherwise(F.col("type"))).withColumn(
            "nullable", F.col("nullable") & ~(odd & (F.col("field_ord") == 6))
        ),
        store=stored,
    )


@query
def canonical_schema(spark, d):
    return schema_exact.canonical_schema(i.catalog(spark, d))


@query
def field_mapping(spark, d):
    return schema_exact.field_mapping(i.catalog(spark, d))


@query
def consistency_score(spark, d):
    return schema_exact.consistency_score(i.catalog(spark, d))


@query
def missing_field_findings(spark, d):
    return schema_exact.missing_field_findings(i.catalog(spark, d)).drop("source_definition", "target_definition")


@query
def type_mismatch_findings(spark, d):
    return schema_exact.type_mismatch_findings(i.catalog(spark, d))


@query
def schema_analysis(spark, d):
    analysis = schema_exact.analyze_schemas(
        i.catalog(spark, d), i.derive(spark, d, i.CATALOG_SYSTEMS), i.derive(spark, d, i.WANTED_ENTITIES)
    )
    return analysis["inconsistencies"].select(*PAIR, "inconsistency_type", "field_name", "severity", "target_definition")


# --- table quality -------------------------------------------------------------------


@query
def dq_completeness(spark, d):
    return quality.completeness(i.derive(spark, d, i.DIRTY_CUSTOMER), "crm", "customer").drop("sample_issues")


@query
def dq_uniqueness(spark, d):
    return quality.profile_tables(
        {
            ("crm", "customer"): i.derive(spark, d, i.DIRTY_CUSTOMER),
            ("web", "events"): i.table(spark, d, "events"),
            ("chat", "conversations"): i.table(spark, d, "conversations"),
        }
    ).filter("check_name = 'uniqueness'").drop("sample_issues")


@query
def dq_null_rate(spark, d):
    return quality.null_rates(i.derive(spark, d, i.DIRTY_CUSTOMER), "crm", "customer")


@query
def dq_score(spark, d):
    return quality.overall_quality(i.derive(spark, d, i.QUALITY), ["run_id"])


@query
def dq_referential(spark, d):
    recent = i.table(spark, d, "orders").filter("o_orderstatus <> 'P'")
    checked = quality.referential_integrity(i.table(spark, d, "lineitem"), "l_orderkey", recent, "o_orderkey", "erp", "lineitem")
    english = i.table(spark, d, "documents").filter("lang = 'en'")
    return checked.unionByName(
        quality.referential_integrity(i.table(spark, d, "labels"), "doc_id", english, "doc_id", "web", "labels")
    )


@query
def dq_format(spark, d):
    return quality.format_consistency(i.table(spark, d, "customer"), ["c_name", "c_mktsegment"], "crm", "customer").unionByName(
        quality.format_consistency(i.table(spark, d, "pages"), ["url"], "web", "pages")
    )


# --- request logs --------------------------------------------------------------------


@query
def req_normalised(spark, d):
    return i.requests(spark, d)


@query
def req_counts(spark, d):
    return req.request_counts(i.requests(spark, d))


@query
def req_rates(spark, d):
    return i.pipeline_metrics(spark, d).select(*req.KEYS, "duration_s", "actual_qps", "error_rate_pct")


@query
def req_percentiles(spark, d):
    return i.pipeline_metrics(spark, d).select(*req.KEYS, "p50_ms", "p95_ms", "p99_ms", "max_ms")


@query
def req_percentiles_by_system(spark, d):
    metrics = req.request_metrics(i.requests(spark, d), ["system_name"])
    return metrics.select("system_name", "successful_requests", "p50_ms", "p95_ms", "p99_ms", "max_ms")


@query
def req_health(spark, d):
    return req.health(i.pipeline_metrics(spark, d)).select(*req.KEYS, "is_healthy", "overall_health")


@query
def req_bottlenecks(spark, d):
    return i.pipeline_bottlenecks(spark, d).select(
        *req.KEYS, "bottleneck_type", "severity", "observed_value", "threshold_value", "unit"
    )


@query
def breaking_points(spark, d):
    by_week = i.requests(spark, d).withColumn("phase", F.floor((F.col("start_us") - 1704067200000000) / 604800000000))
    return req.breaking_points(req.request_metrics(by_week, ["system_name", "phase"]), ["system_name"])


@query
def audit_operations(spark, d):
    return reads.audit_counts(i.requests(spark, d), req.KEYS)


@query
def connection_summary(spark, d):
    tables = i.derive(spark, d, i.EXISTING)
    return req.connection_summary(i.derive(spark, d, i.SYSTEMS), tables)


@query
def connection_details(spark, d):
    details = req.connection_details(i.derive(spark, d, i.SYSTEMS), i.derive(spark, d, i.CONNECTION_TABLES))
    return details.drop("latency_ms").withColumn("tables", F.coalesce("tables", F.lit(-1)))


@query
def dq_uniqueness_sketch(spark, d):
    """Estimates of all customers, merged from sketches per segment, held against exact distinct counts."""
    rows, columns = i.derive(spark, d, i.DIRTY_CUSTOMER), ["customer_id", "account_key", "name"]
    made = stored(sketches.distinct_sketches(rows, ["segment"], columns), "distinct_sketches")
    found = sketches.uniqueness_estimates(sketches.merged_distinct(made, []))
    exact = [rows.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")).distinct() for c in columns]
    exact = reduce(DataFrame.unionByName, exact).groupBy("column").agg(F.count("value").alias("exact"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.col("exact") * (4 * sketches.DISTINCT_ERROR)
    return found.join(exact, "column").select("column", "values", "exact", near.alias("estimate_holds"))


@query
def req_percentiles_sketch(spark, d):
    """Percentiles per system, merged from sketches per run and system, held against the share of latencies below them."""
    requests = i.requests(spark, d)
    made = stored(sketches.latency_sketches(requests, req.KEYS), "latency_sketches")
    found = sketches.latency_estimates(sketches.merged_latencies(made, ["system_name"]))
    latency = F.col("latency_ms")
    near = {
        name: F.avg((latency < F.col(name)).cast("double")).between(0, share + 2 * sketches.RANK_ERROR)
        & (F.avg((latency <= F.col(name)).cast("double")) >= share - 2 * sketches.RANK_ERROR)
        for name, share in (("p50_ms", 0.5), ("p95_ms", 0.95), ("p99_ms", 0.99))
    }
    held = requests.filter("success").join(found.select("system_name", *near), "system_name").groupBy("system_name")
    held = held.agg(*[x.alias(f"{name}_holds") for name, x in near.items()])
    return found.join(held, "system_name").select("system_name", "total_requests", "failed_requests", "max_ms", *[f"{n}_holds" for n in near])


# --- gaps, scores, remediation -------------------------------------------------------


def _run_list(spark, d):
    return i.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"))


def _finding_tables(spark, d, store=lambda df, label: df):
    """Findings, request metrics, bottlenecks, gaps and quality results of the runs.

    Queries that read them more than once pass ``stored``.
    """
    pipeline = store(i.pipeline_metrics(spark, d), "pipeline")
    return {
        "findings": store(i.derive(spark, d, i.FINDINGS), "findings"),
        "pipeline": pipeline,
        "bottlenecks": i.number_bottlenecks(pipeline),
        "gaps": store(i.gap_rows(spark, d), "gaps"),
        "quality": store(i.derive(spark, d, i.QUALITY), "quality"),
    }


def _subscores(t, run_list):
    return scoring.subscores(run_list, t["findings"], t["pipeline"], t["gaps"], t["quality"])


def _readiness(t, run_list):
    return scoring.readiness(run_list, t["findings"], t["pipeline"], t["gaps"], t["quality"])


def _issues(t):
    return t["findings"], t["bottlenecks"], t["gaps"], t["quality"].filter("NOT passed")


@query
def middleware_gaps(spark, d):
    found = gaps.middleware_gaps(i.derive(spark, d, i.SYSTEMS), i.derive(spark, d, i.FINDINGS), i.derive(spark, d, i.EXISTING))
    return found.drop("finding_id")


@query
def gap_effort(spark, d):
    return gaps.total_effort(i.gap_rows(spark, d), _run_list(spark, d))


@query
def subscores(spark, d):
    return _subscores(_finding_tables(spark, d), _run_list(spark, d)).select(
        "run_id", "schema_score", "pipeline_score", "middleware_score", "data_quality_score", "security_score"
    )


@query
def readiness(spark, d):
    return _readiness(_finding_tables(spark, d), _run_list(spark, d))


@query
def readiness_penalty(spark, d):
    scores = scoring.readiness_penalty(_run_list(spark, d), *_issues(_finding_tables(spark, d)))
    return scores.select("run_id", "readiness_score", "verdict")


@query
def readiness_three_part(spark, d):
    t, run_list = _finding_tables(spark, d, stored), _run_list(spark, d)
    return scoring.readiness_three_part(run_list, t["findings"], t["bottlenecks"], t["gaps"], _subscores(t, run_list))


@query
def remediation_plan(spark, d):
    # The findings are written, not the items: those have two hashes each, of which the plan shows one.
    items = remediation.plan_items(*_issues(_finding_tables(spark, d, stored)))
    return remediation.remediation_plan(items).select(
        "run_id",
        "recommended_sequence",
        "title",
        "description",
        "category",
        "priority",
        "severity",
        "effort_min_days",
        "effort_max_days",
        F.array_join("related_gap_ids", ",").alias("related_gap_ids"),
    )


def _needs(spark, d, gaps):
    references = i.derive(spark, d, i.ENTITY_REFERENCES)
    return stored(dependencies.entity_needs(references).unionByName(dependencies.gap_needs(gaps)), "needs")


@query
def plan_tiers(spark, d):
    # Tables that are read once are not written, so that only what names a topic is worked out.
    t = _finding_tables(spark, d, lambda df, label: stored(df, label) if label == "pipeline" else df)
    gaps = stored(t["gaps"].select("run_id", "gap_type"), "gaps")
    topics = remediation.plan_topics(t["findings"], t["bottlenecks"], gaps, t["quality"].filter("NOT passed"))
    return dependencies.topic_tiers(topics, _needs(spark, d, gaps)).na.fill({"tier": -1})


@query
def tiered_plan(spark, d):
    t = _finding_tables(spark, d, stored)
    columns = ["run_id", "kind_ord", "input_ord", "title", "severity", "priority", "topic"]
    items, needs = stored(remediation.plan_items(*_issues(t)).select(columns), "items"), _needs(spark, d, t["gaps"])
    tiers = stored(dependencies.topic_tiers(items.select("run_id", "topic").distinct(), needs), "tiers")
    return dependencies.tiered_plan(items, tiers, needs, remediation.item_id).select(
        "run_id", "recommended_sequence", "title", "topic", F.coalesce("tier", F.lit(-1)).alias("tier"), "item_id", F.array_join("prerequisites", ",").alias("prerequisites")
    )


@query
def remediation_effort(spark, d):
    items = remediation.plan_items(*_issues(_finding_tables(spark, d)))
    return remediation.remediation_effort(items, _run_list(spark, d))


@query
def findings_summary(spark, d):
    return remediation.findings_summary(*_issues(_finding_tables(spark, d)), _run_list(spark, d))


@query
def finding_totals(spark, d):
    return remediation.finding_totals(*_issues(_finding_tables(spark, d)))


@query
def severity_breakdown(spark, d):
    return remediation.severity_breakdown(*_issues(_finding_tables(spark, d)), _run_list(spark, d))


@query
def technical_summary(spark, d):
    return remediation.technical_summary(*_issues(_finding_tables(spark, d)), _run_list(spark, d))


@query
def simple_plan(spark, d):
    return remediation.simple_plan(i.derive(spark, d, i.FINDINGS), i.gap_rows(spark, d), include_high=True)


@query
def exec_summary(spark, d):
    t, run_list = _finding_tables(spark, d, stored), _run_list(spark, d)
    critical = scoring.subscores(run_list, t["findings"]).select("run_id", F.col("schema_critical").alias("critical_schema"))
    summary = remediation.findings_summary(*_issues(t)).join(critical, "run_id")
    return remediation.executive_summary(_readiness(t, run_list), summary, "January 31, 2024")


@query
def exec_summary_penalty(spark, d):
    t = _finding_tables(spark, d, stored)
    scores = scoring.readiness_penalty(_run_list(spark, d), *_issues(t))
    return remediation.executive_summary_penalty(scores, remediation.findings_summary(*_issues(t)))


@query
def top_issues(spark, d):
    return remediation.top_issues(i.derive(spark, d, i.FINDINGS), i.gap_rows(spark, d))


def _portfolio(spark, d):
    fields = i.catalog(spark, d)
    systems = spark.sql(i.RUN_SYSTEMS, catalog=fields)
    return systems.select("run_id").distinct(), spark.sql(i.RUN_CATALOG, catalog=fields), systems


@query
def assessment(spark, d):
    return assess(*_portfolio(spark, d), assessed_on="January 31, 2024")["scores"]


@query
def assessment_exact(spark, d):
    run_list, catalog, _ = _portfolio(spark, d)
    result = assess_exact(run_list, catalog)
    return result["scores"].join(result["effort"], "run_id").select(
        "run_id", "readiness_score", "verdict", "item_count", "min_days", "max_days"
    )


# --- run tables ----------------------------------------------------------------------


@query
def upsert_latest(spark, d):
    changes = i.derive(spark, d, i.RUN_CHANGES)
    old = changes.filter("status = 'running'")
    new = changes.filter("status <> 'running'")
    return _with_time_text(runs.upsert_latest(old, new, ["run_id"], ["changed_at", "version_ord"]), "changed_at")


@query
def run_by_id(spark, d):
    return _with_time_text(runs.find_by_id(i.derive(spark, d, i.RUN_CHANGES), "run_id", 7), "changed_at")


@query
def runs_newest(spark, d):
    return _with_time_text(runs.newest_first(i.derive(spark, d, i.RUN_CHANGES), "changed_at", "version_ord"), "changed_at")


@query
def connections_of_run(spark, d):
    return runs.children_of(i.derive(spark, d, i.SYSTEMS), 7, "name")


@query
def cascade_delete(spark, d):
    children = {
        "schema_findings": i.derive(spark, d, i.FINDINGS),
        "bottlenecks": i.pipeline_bottlenecks(spark, d),
        "gaps": i.gap_rows(spark, d),
        "quality": i.derive(spark, d, i.QUALITY),
        "connections": i.derive(spark, d, i.SYSTEMS),
        "runs": _run_list(spark, d),
    }
    failed = i.table(spark, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("run_id"))
    return runs.surviving_counts(children, failed)


@query
def run_progress(spark, d):
    return _with_time_text(runs.run_progress(i.derive(spark, d, i.RUN_CHANGES)), "started_at", "completed_at")


@query
def progress_ttl(spark, d):
    return _with_time_text(runs.latest_progress(i.derive(spark, d, i.RUN_CHANGES), ttl_seconds=30 * 86400), "changed_at")


@query
def runs_by_status(spark, d):
    return runs.runs_by_status(runs.latest_by(i.derive(spark, d, i.RUN_CHANGES), ["run_id"], ["changed_at", "version_ord"]))


# --- streams -------------------------------------------------------------------------


def _event_stream(spark, d):
    schema = i.table(spark, d, "events").schema
    stream = parquet_stream(spark, d, "events.parquet", schema)
    return stream.withColumn("event_time", F.col("ts").cast("timestamp"))


def _request_stream(spark, d):
    raw = spark.sql(i.RAW_REQUESTS, events=_event_stream(spark, d))
    return req.normalise_outcomes(raw.withColumn("event_time", F.col("start_ts").cast("timestamp")))


@query
def stream_req_windows(spark, d):
    stream = stream_events.request_windows(_request_stream(spark, d), delay=None)
    windows = update_available(stream, "request_windows", [*stream_events.WINDOW_KEYS, "system_name"])
    metrics = stream_events.window_metrics(windows)
    return metrics.select(
        _time_text("window_start"), "system_name", "total_requests", "failed_requests", "error_rate_pct",
        "p50_ms", "p95_ms", "p99_ms", "max_ms", "overall_health",
    )


@query
def stream_dedup(spark, d):
    twice = _event_stream(spark, d).union(_event_stream(spark, d))
    return append_available(stream_events.deduplicate(twice, delay=None), "events_once").select("event_id", "user_id", "event_type", "value")


@query
def stream_run_state(spark, d):
    orders = parquet_stream(spark, d, "orders.parquet", i.table(spark, d, "orders").schema)
    states = stream_events.run_states(spark.sql(i.RUN_CHANGES, orders=orders))
    return _with_time_text(update_available(states, "run_states", ["run_id"]), "started_at", "completed_at")


@query
def stream_progress_ttl(spark, d):
    orders = parquet_stream(spark, d, "orders.parquet", i.table(spark, d, "orders").schema)
    changes = spark.sql(i.RUN_CHANGES, orders=orders).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    latest = update_available(stateful.latest_progress(changes, ttl_seconds=30 * 86400), "progress", ["run_id"])
    return _with_time_text(latest.filter("NOT expired").drop("expired"), "changed_at")


@query
def stream_run_lifecycle(spark, d):
    orders = parquet_stream(spark, d, "orders.parquet", i.table(spark, d, "orders").schema)
    states = runs.run_lifecycles(spark.sql(i.RUN_CHANGES, orders=orders))
    return _with_time_text(update_available(states, "lifecycles", ["run_id"]), "changed_at")


@query
def stream_event_counts(spark, d):
    events = _event_stream(spark, d).withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    stream = stream_events.event_counts(events, "k", delay=None)
    counts = update_available(stream, "event_counts", ["window_start", "window_end", "event_type"])
    return counts.select(_time_text("window_start"), "event_type", "event_count", "payload_total")
