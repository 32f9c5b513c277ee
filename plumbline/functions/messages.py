"""Texts of findings, plan items and summaries."""

# Wording of results; a name in braces stands for a column.

# Similar-name comparison.
FIELD_MISSING = "Field '{field}' present in {source} but missing in {target}"
FIELD_TYPES_DIFFER = "Field '{field}': {source_type} in {source} vs {target_type} in {target}"
KEYS_DIFFER = "Key fields differ: {source_keys} vs {target_keys}"
REVIEW_FIELDS = "Review field definitions and align schemas"

# Exact-name comparison.
ABSENT_IMPACT = (
    "Field '{field}' exists in {source} but is absent in {target}. Queries spanning both systems may fail or return nulls."
)
ABSENT_HINT = "Add field '{field}' to {target} or implement a transformation/default in the integration layer."
TYPE_IMPACT = (
    "Field '{field}' has type '{source_type}' in {source} but '{target_type}' in {target}. "
    "Data type coercion may silently corrupt values."
)
TYPE_HINT = "Align the type of '{field}' between {source} and {target}, or add explicit casting in the ETL pipeline."

# Integration gaps.
NO_API_GATEWAY = "No API gateway detected for {systems} systems"
NO_ETL_PIPELINE = "Schema inconsistencies require ETL pipeline for data harmonization"
NO_SEMANTIC_LAYER = "AI agents need a semantic layer to understand business entities across systems"
NO_REST_API = "ERP systems typically lack REST APIs suitable for real-time AI agent queries"

# Plan items.
SCHEMA_TITLE = "Resolve {kind} for '{entity}'"
BOTTLENECK_TITLE = "Resolve {kind} bottleneck in '{pipeline}' on {system}"
BOTTLENECK_TEXT = "{description} (observed {observed}{unit}, threshold {threshold}{unit})"
GAP_TITLE = "Implement {kind} between {source} and {target}"
GAP_TEXT = "{description} Recommended solution: {solution}"
QUALITY_TITLE = "Data quality issue #{number}"
SHORT_GAP_TITLE = "Implement {kind}"
SHORT_CRITICAL = ("Resolve Critical Schema Mismatches", "Fix {n} critical key/schema mismatches across systems")
SHORT_HIGH = ("Resolve High-Severity Schema Issues", "Fix {n} high-severity schema issues")

# Summary of the weighted scorer.
VERDICT_INTROS = {
    "GO": "Your enterprise infrastructure appears well-positioned for the proposed AI deployment.",
    "NOT_YET": "Your enterprise infrastructure needs targeted improvements before AI deployment can succeed.",
    "NOT_READY": "Significant infrastructure gaps were identified that would prevent a successful AI deployment.",
}
OTHER_INTRO = "Analysis complete."
SUMMARY_HEAD = "**Readiness Assessment: {score}% — {verdict}**"
SUMMARY_SCHEMA = "**Schema Consistency:** {n} inconsistencies found across connected systems{critical}."
SUMMARY_CRITICAL = ", including {n} critical mismatches that would cause AI agent failures"
SUMMARY_PIPELINE = "**Pipeline Performance:** {n} performance bottleneck(s) detected under simulated AI agent load."
SUMMARY_GAPS = "**Integration Gaps:** {n} missing middleware component(s) identified{blocking}."
SUMMARY_BLOCKING = ", with {n} blocking deployment"
SUMMARY_WEEKS = "\n**Estimated Remediation Timeline:** {low}–{high} weeks to reach deployment readiness."
SUMMARY_READ_ONLY = "This assessment was conducted using read-only access to your systems. No data was modified."
SUMMARY_DATE = "Assessment date: {date}"

# Summary of the penalty scorer.
VERDICT_PHRASES = {
    "GO": "systems are well-positioned for AI deployment",
    "NOT_YET": "systems require moderate remediation before AI deployment",
    "NOT_READY": "systems are not yet ready for AI deployment and require significant work",
}
ALL_SYSTEMS = "the connected enterprise systems"
PLANNED_DEPLOYMENT = "the planned AI deployment"
PENALTY_HEAD = (
    "The {assessment} diagnostic assessment indicates that {systems} {verdict} with a readiness score of {score}/100."
)
PENALTY_CRITICAL = (
    "The assessment identified {n} critical issue(s) that require immediate attention prior to proceeding with any AI "
    "workload deployment."
)
PENALTY_BLOCKING = (
    "{n} middleware gap(s) are currently blocking and must be resolved before the AI workload can function correctly."
)
PENALTY_TOTAL = (
    "A total of {n} findings were recorded across schema consistency, pipeline performance, and middleware coverage dimensions."
)
PENALTY_PLAN = (
    "The recommended remediation plan contains {n} action items to bring the environment to a GO state for {use_case}."
)

# Lines of the technical summary.
TECHNICAL_HEAD = "=== Technical Readiness Summary ==="
TECHNICAL_KINDS = {
    "schema": "Schema Inconsistencies : {n}",
    "pipeline": "Pipeline Bottlenecks   : {n}",
    "middleware": "Middleware Gaps        : {n}",
    "data_quality": "Data Quality Issues    : {n}",
}
TECHNICAL_BLOCKING = "  Blocking            : {n}"
