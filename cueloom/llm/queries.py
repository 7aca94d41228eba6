"""One query for each operator, over its whole table with production parameters, and the SQL of those that SQL can express."""

from . import decontamination, exact_dedup, language_id, licenses, line_dedup, lm_scoring, mixing, near_dedup, pii, secrets

QUERIES = {
    f.__name__: f
    for f in (
        near_dedup.op1_minhash_near_dedup,
        language_id.op2_language_id,
        mixing.op3_source_mixing,
        licenses.op4_license_scan,
        line_dedup.op5_line_dedup,
        exact_dedup.op6_exact_dedup,
        pii.op7_pii_scan,
        decontamination.op8_benchmark_decontamination,
        secrets.op9_secret_scan,
        lm_scoring.op10_lm_scoring,
    )
}
ORACLE: dict[str, str] = {"op4_license_scan": licenses.sql(), "op6_exact_dedup": exact_dedup.OP6_SQL}
