"""Column expressions: every function takes Columns and returns a Column, all built in."""

from palisade.functions.identifiers import (  # noqa: F401
    coordinate, dep_key, git_secret_id, mask_db_url, mask_secret, mask_webhook, purl,
    clean_npm_version, shannon_entropy, truncate_evidence, version_key, package_key,
)
from palisade.functions.paths import (  # noqa: F401
    base_name, clean_path, config_type, display_path, glob_match, has_excluded_dir,
    is_config_file, is_manifest, is_uploadable, manifest_kind, suffix, target_badge, target_label,
)
from palisade.functions.severity import (  # noqa: F401
    compliance_label, count_bucket, cvss_to_severity, cvss_vector_estimate, map_sast_severity,
    normalize_severity, priority, risk_label, sarif_level, score_to_severity, severity_rank, urgency,
)
from palisade.functions.texts import (  # noqa: F401
    impact, is_allowed_git_url, is_public_address, is_webhook_url, parse_git_evidence,
    patch_added_lines, why_it_matters,
)
