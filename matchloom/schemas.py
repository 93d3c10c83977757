"""Explicit schemas as DDL; none is inferred."""

IMPORT = ("full_name string, email string, phone string, location string, source_reference string, retention_until string")
CANDIDATE = ("candidate_id bigint, org_id int, full_name string, email string, phone string, location string, status string, retention_until date, deletion_requested_at timestamp, status_before_deletion_request string, deleted_at timestamp")
CANDIDATE_SKILL = ("candidate_id bigint, skill string, source_label string, evidence string, years_tenths int")
REQUIREMENT_SKILL = ("requirements_id bigint, skill string, source_label string, importance string, pos int")
RULE = ("requirements_id bigint, rule_type string, expected string, tenths int")
USAGE = ("event_id bigint, org_id int, workflow string, status string, provider_request_id string, model string, duration_ms decimal(16,3), retries_used int, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd decimal(18,9), failure_stage string, failure_code string, started_at timestamp, completed_at timestamp")

SKILLS = ("skills array<struct<name:string,evidence:string,years_experience:decimal(4,1)>>")
PROFILE = (
    "summary string, summary_evidence string, location string, location_evidence string, work_mode string, work_mode_evidence string, availability string, availability_evidence string, "
    "skills array<struct<name:string,evidence:string,years_experience:decimal(4,1)>>, "
    "employment array<struct<job_title:string,employer:string,period:string,evidence:string>>, languages array<struct<language:string,proficiency:string,evidence:string>>, "
    "education array<struct<qualification:string,institution:string,evidence:string>>, certifications array<struct<name:string,issuer:string,evidence:string>>, "
    "employment_types array<string>, employment_types_evidence string"
)
FINDING = ("requirement_id string, requirement_label string, requirement_evidence string, category string, explanation string, candidate_evidence array<struct<id:string,label:string,evidence:string>>")
BREAKDOWN = "array<struct<pos:int,skill:string,importance:string,matched:boolean,awarded_cents:int,possible_cents:int>>"
DATASET = (
    "dataset_id string, candidates array<struct<code:string,full_name:string,location:string,summary:string,skills:array<string>>>, "
    "vacancies array<struct<code:string,title:string,description:string,summary:string,must_have_skills:array<string>,nice_to_have_skills:array<string>,"
    "expected_top:array<struct<candidate_code:string,score:decimal(5,2)>>,relevance_judgments:map<string,int>>>"
)
