"""Constraints of the stored tables, as rules.

Tables go by the names below; `quality_rules.run` takes them under these names.
"""

from __future__ import annotations

from .quality_rules import Check, Reference, Unique

# names and conditions of constraints; fixed values
RULES = [
    # Runs and their entries
    Check("match_run_limit_is_positive", "match_run", "run_id", "shortlist_limit >= 1"),
    Check("match_run_eligible_not_above_evaluated", "match_run", "run_id", "eligible_count <= evaluated_count"),
    Check("match_run_shortlisted_not_above_eligible", "match_run", "run_id", "shortlisted_count <= eligible_count"),
    Check("match_run_shortlisted_not_above_limit", "match_run", "run_id", "shortlisted_count <= shortlist_limit"),
    Unique("unique_candidate_per_match_run", "shortlist_entry", ("run_id", "candidate_id")),
    Unique("unique_rank_per_match_run", "shortlist_entry", ("run_id", "rank")),
    Check("shortlist_entry_rank_is_positive", "shortlist_entry", "run_id", "rank >= 1"),
    Check("shortlist_entry_score_in_range", "shortlist_entry", "run_id", "score >= 0 and score <= 100"),
    Check("shortlist_entry_has_eligible_filter_outcome", "shortlist_entry", "run_id", "filter_outcome in ('passed', 'review')"),
    Check("shortlist_must_match_not_above_total", "shortlist_entry", "run_id", "matched_must <= total_must"),
    Reference("shortlist_entry_run", "shortlist_entry", "run_id", "match_run", "run_id"),
    # K8: the audit ledger and the usage ledger
    Check("audit_event_has_valid_action", "audit_event", "event_id", "action in ('candidate_deletion_requested', 'candidate_retention_flagged', 'candidate_deletion_cancelled', 'candidate_deleted', 'candidate_document_downloaded', 'vacancy_deleted')"),
    Check("audit_event_has_valid_object_type", "audit_event", "event_id", "object_type in ('candidate', 'candidate_document', 'vacancy')"),
    Check(
        "audit_event_action_matches_object", "audit_event", "event_id",
        "(action in ('candidate_deletion_requested', 'candidate_retention_flagged', 'candidate_deletion_cancelled', 'candidate_deleted') and object_type = 'candidate') or (action = 'candidate_document_downloaded' and object_type = 'candidate_document') or (action = 'vacancy_deleted' and object_type = 'vacancy')",
    ),
    Check("ai_usage_completion_matches_status", "ai_usage_event", "event_id", "(status = 'pending' and completed_at is null) or (status in ('succeeded', 'failed') and completed_at is not null)"),
    Check("ai_usage_failure_fields_match_status", "ai_usage_event", "event_id", "(status = 'failed' and failure_stage <> '' and failure_code <> '') or (status <> 'failed' and failure_stage = '' and failure_code = '')"),
    Check("ai_usage_success_has_result_metadata", "ai_usage_event", "event_id", "status <> 'succeeded' or (provider_request_id <> '' and model <> '' and result_type <> '' and result_id is not null)"),
    Check("ai_usage_result_reference_complete", "ai_usage_event", "event_id", "(result_type = '' and result_id is null) or (result_type <> '' and result_id is not null)"),
    # Q1: people, intake, profiles, vacancies, jobs and memberships
    Check("deleted_candidate_has_timestamp", "candidate", "candidate_id", "status <> 'deleted' or deleted_at is not null"),
    Check("candidate_deletion_request_has_timestamp", "candidate", "candidate_id", "status <> 'deletion_requested' or deletion_requested_at is not null"),
    Check("candidate_profile_version_positive", "assessment", "entry_id", "version >= 1"),
    Unique("unique_candidate_profile_version", "assessment", ("entry_id", "version")),
    Check("job_task_valid_status", "background_task", "job_id", "status in ('queued', 'succeeded', 'failed')"),
    Check("vacancy_valid_status", "vacancy", "vacancy_id", "status in ('open', 'paused', 'closed')"),
    Unique("unique_membership", "membership", ("user_id", "org_id")),
    Reference("membership_organization", "membership", "org_id", "organization", "org_id"),
    # several columns and one tenant
    Unique("unique_skill_per_candidate", "candidate_skill", ("candidate_id", "skill")),
    Unique("unique_source_document_per_skill", "candidate_skill", ("source_document_id", "skill")),
    Unique("unique_skill_per_requirements", "requirement_skill", ("requirements_id", "skill")),
    Unique("unique_requirement_skill_position", "requirement_skill", ("requirements_id", "importance", "pos")),
    Unique("unique_requirements_version", "vacancy_requirements", ("requirements_id", "version")),
    Check("requirements_version_positive", "vacancy_requirements", "requirements_id", "version >= 1"),
    Check("requirement_skill_valid_importance", "requirement_skill", "requirements_id", "importance in ('must_have', 'nice_to_have')"),
    Check("candidate_skill_years_in_range", "candidate_skill", "candidate_id", "years_tenths >= 0 and years_tenths <= 800"),
    Check("candidate_document_valid_type", "candidate_document", "document_id", "document_type in ('cv', 'other')"),
    Check("candidate_document_valid_extraction_status", "candidate_document", "document_id", "extraction_status in ('pending', 'succeeded', 'failed')"),
    Reference("requirement_skill_requirements", "requirement_skill", "requirements_id", "vacancy_requirements", "requirements_id"),
    Reference("source_candidate_known", "candidate_source", "candidate_id", "candidate", "candidate_id"),
    Reference("document_candidate_of_the_tenant", "candidate_document", ("org_id", "candidate_id"), "candidate", ("org_id", "candidate_id")),
]
