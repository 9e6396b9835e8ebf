"""Names, word lists, patterns and limits that must equal the studied system's for results to agree.

They are data, not logic.  Anything larger (the skill taxonomy) is a parameter read from a file.
"""

# Ordinal labels: position = label id.
LABELS = ["No Fit", "Potential Fit", "Good Fit"]
CATEGORIES = ["Weak match", "Potential match", "Strong match"]
SEED = 42
SPLIT_RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}
NEAR_DUP_COSINE = 0.9
RANKING_METRICS = ["mrr", "map", "ndcg_5", "ndcg_10", "p_1", "p_5"]

# Text normalisation: noise characters and headings that are glued to the next word.
NOISE_CHARS = "[�​•▪●·*|]"
GLUED_HEADINGS = ["Summary", "Skills", "Highlights", "Experience", "Education", "Qualifications",
                  "Accomplishments", "Certifications", "Projects", "Interests"]

# Headings by kind: phrases (regular expressions) in rule order.
JOB_HEADINGS = {
    "preferred": ["preferred qualifications?", "preferred skills", "preferred experience", "preferred requirements",
                  "nice[- ]to[- ]haves?", "bonus points", "bonus", "desired qualifications", "desired skills",
                  "desired experience", "pluses", "preferred"],
    "required": ["required qualifications?", "minimum qualifications?", "basic qualifications?", "required skills",
                 "required experience", "requirements", "job requirements", "must[- ]haves?", "what you need",
                 "what you(?:'|’)ll need", "what we(?:'|’)re looking for", "who you are", "qualifications",
                 "skills and qualifications", "skills (?:&|and) experience", "experience and skills",
                 "knowledge,? skills,? (?:and|&) abilities"],
    "responsibilities": ["(?:key |primary |main |core |essential |major )?(?:job )?(?:responsibilities|duties)",
                         "essential (?:job )?functions", "duties and responsibilities", "what you(?:'|’)ll do",
                         "what you will do", "the role", "your role", "day[- ]to[- ]day", "in this role"],
    "other": ["benefits", "perks", "about us", "about the company", "about the team", "who we are", "compensation",
              "salary", "pay range", "equal (?:employment )?opportunity", "eeo", "why join", "our culture",
              "location", "physical requirements", "work environment"],
}
RESUME_HEADINGS = {
    "experience": ["(?:work |professional |relevant |employment |career )?experience", "work history",
                   "employment history", "career history", "employment"],
    "education": ["education(?: and training)?", "academic background", "academics"],
    "projects": ["projects"],
    "certifications": ["certifications?"],
    "other": ["skills", "technical skills", "highlights", "summary", "professional summary", "executive summary",
              "core competencies", "accomplishments", "interests", "additional information", "languages",
              "affiliations", "activities", "awards", "objective", "profile"],
}
REQUIRED_CUES = ["required", "requires?", "requirements?", "mandatory", "must", "essential", "minimum", "needs?",
                 "needed", "necessary"]
PREFERRED_CUES = ["preferred", "prefer", "nice[- ]to[- ]have", "bonus", "desirable", "desired",
                  "(?:is|are|a|considered a|big) plus", "advantage(?:ous)?", "ideally"]
STATUS_STRENGTH = {"required": 2, "preferred": 1, "uncertain": 0}

# Years, dates and degrees.
NUMBER_WORDS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
                "ten": 10, "twelve": 12, "fifteen": 15}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MAX_REQUIRED_YEARS = 30
MAX_CAREER_YEARS = 50
DEGREE_NAMES = {1: "High school", 2: "Associate", 3: "Bachelor", 4: "Master", 5: "Doctorate"}
DEGREE_PATTERNS = {
    5: r"(?i:ph\.?\s?d|doctorate|doctoral|juris doctor|doctor of)",
    4: r"(?i:master(?:['’]?s|\s+of|\s+degree|\s+in\b|\s*:)|mba|m\.b\.a|msc|m\.sc|m\.s\.|m\.eng)"
       r"|M\.?S(?=\s*(?:[:,(]|in\b|degree))",
    3: r"(?i:bachelor|b\.s\.?c?|b\.a\.|b\.tech|b\.e\.|bba|undergraduate degree|(?:4|four)[- ]year (?:college )?degree)"
       r"|B\.?S(?=\s*(?:[:,(]|in\b|degree|[A-Z][a-z]))|B\.?A(?=\s*(?:[:,(]|in\b|degree))|B\.?E(?=\s*[:,(])",
    2: r"(?i:associate['’]?s?\s+degree|associate of (?:arts|science|applied)|a\.a\.s)",
    1: r"(?i:high school|ged|secondary school)",
}

# Duty statements.
MIN_DUTY_WORDS = 4

# Pair score components, weightings and ablation stages.
COMPONENTS = ["semantic_similarity", "required_skill_coverage", "preferred_skill_coverage", "experience_match",
              "responsibility_similarity"]
COUNT_OF_COVERAGE = {"required_skill_coverage": "required_skill_count",
                     "preferred_skill_coverage": "preferred_skill_count"}
PREFERRED_ALPHA = 0.5
WEIGHTINGS = {
    "A_initial": [0.40, 0.25, 0.10, 0.10, 0.15],
    "B_semantic_heavy": [0.60, 0.15, 0.05, 0.10, 0.10],
    "C_balanced": [0.25, 0.25, 0.10, 0.15, 0.25],
    "D_skill_heavy": [0.30, 0.40, 0.15, 0.05, 0.10],
    "E_experience_heavy": [0.30, 0.20, 0.10, 0.30, 0.10],
    "F_responsibility_heavy": [0.30, 0.20, 0.05, 0.10, 0.35],
}
ABLATION_STAGES = {"A_semantic_only": 1, "B_+required_skills": 2, "C_+preferred_skills": 3, "D_+experience": 4,
                   "E_+responsibilities": 5}

# Error analysis.
ERROR_CATEGORIES = ["A_tfidf_ok_bge_fails", "B_bge_ok_tfidf_fails", "C_hybrid_ok_bge_fails",
                    "D_bge_ok_hybrid_fails", "E_all_fail"]
ERROR_TAGS = ["missing_required_skill", "semantic_similarity_despite_missing_requirement", "responsibility_mismatch",
              "terminology_mismatch", "experience_mismatch", "generic_job_boilerplate",
              "insufficient_requirement_or_candidate_evidence"]

# Privacy scan.
SCAN_EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
SCAN_PHONE = r"(?<!\d)(?:\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}(?!\d)"
SCAN_URL = r"(?i)https?://|www\."
FORBIDDEN_COLUMNS = ["resume", "resume_text", "job_description", "job_description_text", "name", "email", "phone",
                     "address", "gender", "age", "race", "religion", "nationality", "marital_status", "photo"]
MAX_CELL_CHARS = 120

# Application pages: contact patterns, check words, stop words, statuses, tones.
CONTACT_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
CONTACT_PHONE = r"(?:\+?\d{1,3}[-.\s]*)?\(?\d{3}\)?[-.\s]*\d{3}[-.\s]*\d{4}"
CONTACT_LINKEDIN = r"(?i)(?:https?://)?(?:www\.)?linkedin\.com/in/([a-zA-Z0-9_-]+)"
CONTACT_GITHUB = r"(?i)(?:https?://)?(?:www\.)?github\.com/([a-zA-Z0-9_-]+)"
CONTACT_PORTFOLIO = r"(?i)(?:https?://)?([a-zA-Z0-9-]+\.(?:dev|me|io|com|org|tech|co))(?:/[^\s]*)?"
CONTACT_LOCATION = (r"([A-Z][a-zA-Z\s]+,\s*[A-Z]{2}(?:\s+\d{5})?|[A-Z][a-zA-Z\s]+,\s*"
                    r"(?:United States|USA|Canada|UK|United Kingdom|Germany|India|Australia|Singapore))")
DEFAULT_LOCATION = "Remote / Open to Relocation"
ACTION_VERBS = ["developed", "engineered", "led", "architected", "spearheaded", "reduced", "increased", "optimized",
                "implemented", "designed", "delivered"]
QUANTITY = r"(?i)(\d+%\s*|\$\d+|\b\d+\s*(?:users|clients|requests|ms|million|k)\b)"
BULLET_QUANTITY = r"(?i)(\d+%\s*|\$\d+|\b\d+\s*(?:users|ms|times|k|million)\b)"
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "have", "are", "was", "were", "will", "been",
              "their", "they", "our", "what", "which", "who", "whom", "into", "onto", "about", "than", "such", "more",
              "some", "other", "then", "them", "these", "those", "also", "over", "only", "would", "could"]
STATUSES = ["saved", "applied", "screening", "interviewing", "offer", "rejected"]
SENIORITY_PATTERNS = [("executive", r"\b(vp|director|head of|chief|cto|cfo|executive)\b"),
                      ("lead", r"\b(principal|staff|lead|architect|manager)\b"),
                      ("senior", r"\b(senior|sr\.?|lead developer|experienced)\b"),
                      ("entry", r"\b(junior|jr\.?|intern|entry|graduate|associate)\b")]
DEFAULT_YEARS = {"executive": 3, "lead": 7, "senior": 5, "entry": 1, "mid": 3}
