"""Vocabularies, patterns and thresholds that results depend on.

Every operator takes these as arguments with the values below as defaults.
"""

# Skill aliases (normalised text -> canonical name).
SKILL_ALIASES = {
    "lang chain": "LangChain",
    "langchain": "LangChain",
    "langchain framework": "LangChain",
    "lang graph": "LangGraph",
    "langgraph": "LangGraph",
    "postgres": "PostgreSQL",
    "postgresql": "PostgreSQL",
    "postgresql database": "PostgreSQL",
    "aws": "AWS",
    "aws cloud": "AWS",
    "rag": "RAG",
    "retrieval augmented generation": "RAG",
    "retrieval-augmented generation": "RAG",
    "vector db": "Vector Databases",
    "vector database": "Vector Databases",
    "vector databases": "Vector Databases",
    "ci/cd": "CI/CD",
    "ci/cd pipeline": "CI/CD",
    "cicd": "CI/CD",
    "llms": "LLM",
}

# Role aliases.
ROLE_ALIASES = {
    "genai engineer": "Generative AI Engineer",
    "gen ai engineer": "Generative AI Engineer",
    "llm engineer": "Generative AI Engineer",
}

# Seniority aliases.
SENIORITY_ALIASES = {
    "intern": "Internship",
    "internship": "Internship",
    "entry level": "Entry-Level",
    "entry-level": "Entry-Level",
    "junior": "Junior",
    "associate": "Associate",
    "mid level": "Mid-Level",
    "mid-level": "Mid-Level",
    "mid-senior": "Mid-Level",
    "mid-senior level": "Mid-Level",
    "senior": "Senior",
    "staff": "Staff",
    "principal": "Principal",
    "lead": "Lead",
    "manager": "Manager",
}

# Seniority labels a profile may carry.
SENIORITY_LEVELS = [
    "Internship", "Entry-Level", "Junior", "Associate", "Mid-Level",
    "Senior", "Staff", "Principal", "Lead", "Manager",
]

# Labels counted as entry or mid level.
ENTRY_MID_LABELS = ["Entry-Level", "Junior", "Mid-Level", "Associate", "Internship"]

# Seniority -> experience filter of the job search.
EXPERIENCE_LEVELS = {
    "Internship": "internship",
    "Entry-Level": "entryLevel",
    "Junior": "entryLevel",
    "Associate": "associate",
    "Mid-Level": "midSeniorLevel",
    "Senior": "midSeniorLevel",
    "Staff": "midSeniorLevel",
    "Principal": "midSeniorLevel",
    "Lead": "midSeniorLevel",
    "Manager": "director",
}

# Capability rules in order, first match wins, case-insensitive.
CAPABILITY_RULES = [
    (r"\brag\b|retrieval.augmented|retrieval pipeline", "Build RAG Systems"),
    (r"\bagents?\b.*\b(build|design|develop)\b|\b(build|design|develop)\b.*\bagents?\b", "Build AI Agents"),
    (r"multi-agent|multi agent", "Design Multi-Agent Systems"),
    (r"\bmcp\b|model context protocol", "Implement MCP Integrations"),
    (r"observab", "Implement AI Observability"),
    (r"evaluat", "Implement AI Evaluation"),
    (r"deploy", "Deploy AI Applications"),
    (r"scalab|scalable ai system|design.*ai system", "Design Scalable AI Systems"),
    (r"production[- ]grade ai|production ai system", "Develop Production AI Systems"),
    (r"backend (api|service)|\bapi\b.*\bbackend\b", "Build Backend APIs"),
]

# Document keys of the tri-state flags.
PRODUCTION_FLAGS = [
    "production_systems", "scalability", "reliability", "cloud", "containerization",
    "deployment", "monitoring", "observability", "cicd",
]
ENGINEERING_FLAGS = [
    "backend_development", "api_development", "system_design", "clean_architecture",
    "testing", "code_quality",
]
LIFECYCLE_FLAGS = [
    "data_ingestion", "data_processing", "model_development", "rag_pipeline",
    "agent_development", "evaluation", "deployment", "monitoring",
]

# Column widths; a longer value rejects its document.
WIDTHS = {
    "external_job_id": 100, "city": 100, "state": 100, "country": 100,
    "employment_type": 50, "skill": 150, "category": 100, "role": 150, "seniority": 50,
}

# Priority buckets, strongest first.
PRIORITIES = ["critical", "important", "preferred"]

# Statuses after which a run is no longer active.
TERMINAL_STATUSES = ["completed", "completed_with_errors", "failed"]

# Actor status -> run status.
RUN_STATUSES = {
    "SUCCEEDED": "succeeded", "FAILED": "failed", "ABORTED": "failed", "TIMED-OUT": "timed_out",
}

# Caps of the generated query lists.
QUERY_CAPS = {"primary_queries": 5, "secondary_queries": 8, "keywords": 15}

# Taxonomy dimensions with a canonical table.
CANONICAL_TABLES = {"skill": "skills", "capability": "capabilities", "role": "roles"}
MAX_MERGE_HOPS = 5

# Job search address, page size and parameter codes.
SEARCH_URL = "https://www.linkedin.com/jobs-guest/jobs/api/seeMoreJobPostings/search"
JOB_VIEW_URL = "https://www.linkedin.com/jobs/view/"
PAGE_SIZE = 25
DATE_POSTED_CODES = {"past24Hours": "r86400", "pastWeek": "r604800", "pastMonth": "r2592000"}
EXPERIENCE_CODES = {
    "internship": "1", "entryLevel": "2", "associate": "3",
    "midSeniorLevel": "4", "director": "5", "executive": "6",
}
JOB_TYPE_CODES = {
    "fullTime": "F", "partTime": "P", "contract": "C", "temporary": "T",
    "volunteer": "V", "internship": "I", "other": "O",
}
REMOTE_CODES = {"onSite": "1", "remote": "2", "hybrid": "3"}

# Texts stored or shown with results.
INSUFFICIENT = "Insufficient historical data"
MISSING_JOB_ID = "Missing job_metadata.job_id"

# Fixed value: the note stored with a value whose rule names an entity that doesn't exist yet.
RULE_NOTE = 'Deterministic rule suggests canonical name "%s", which has no matching row yet in the canonical table.'
