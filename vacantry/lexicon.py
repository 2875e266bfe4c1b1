"""Word lists, labels, rates and lookup tables.

Everything here is a value results depend on.  Larger vocabularies (skills,
title-exclusion families, taxonomies) are parameters and come from files or
tables, see ``vacantry.sources.tables``.
"""

# --- fixed values: labels -------------------------------------------------
ROLE_LABELS = [
    "Primary role", "Adjacent role", "Leadership progression", "Conditional",
    "Out of scope", "Unclassified", "Exact architecture", "Adjacent technical",
    "Leadership lateral", "Data-domain stretch",
]
UNCLASSIFIED = "Unclassified"
OUT_OF_SCOPE = "Out of scope"
TAXONOMY_VERSION = "3"

EXACT_LABELS = ["posted_exact", "external_exact", "api_exact_match", "unknown_exact"]
ESTIMATE_LABELS = [
    "aggregated_exact_title", "company_benchmark", "estimated_market",
    "official_baseline", "unknown_estimate",
]
# best first
CONFIDENCE_ORDER = [
    "posted_exact", "external_exact", "api_exact_match", "aggregated_exact_title",
    "company_benchmark", "estimated_market", "official_baseline",
    "unknown_exact", "unknown_estimate",
]
MATCHED_BY = [
    "exact_job", "title_company_location", "title_company", "role_location",
    "company_role_level", "occupation_baseline", "manual",
]
COMPENSATION_TYPES = ["base_salary", "total_compensation", "ote", "contract_rate", "unknown"]
STAGES = ["applied", "screening", "interview", "offer", "rejected", "withdrawn", "ghosted"]
# board order, best first; anything else sorts after
BOARD_ORDER = ["offer", "interview", "screening", "applied", "ghosted", "rejected"]

# --- fixed values: pay ----------------------------------------------------
PERIOD_FACTORS = {"hour": 1820, "day": 220, "week": 52, "month": 12, "year": 1}
PERIOD_NOTES = {
    "hour": "hour × 1820 working hours",
    "day": "day × 220 working days",
    "week": "week × 52 weeks",
    "month": "month × 12 months",
    "year": "year × 1",
}
SYMBOL_CURRENCY = {"£": "GBP", "$": "USD", "€": "EUR", "CHF": "CHF", "AED": "AED"}
EXPECTED_CURRENCY = {
    "GB": "GBP", "US": "USD", "CH": "CHF", "AE": "AED", "CA": "CAD", "AU": "AUD",
    "DE": "EUR", "FR": "EUR", "NL": "EUR", "IE": "EUR", "ES": "EUR", "IT": "EUR",
}
BENCHMARK_SOURCES = {
    "GB": ["itjobswatch", "indeed", "levels_fyi", "robert_half", "salaryexpert"],
    "IE": ["indeed", "levels_fyi", "robert_half", "salaryexpert"],
    "US": ["levels_fyi", "indeed", "robert_half", "salaryexpert"],
    "CA": ["levels_fyi", "indeed", "robert_half", "salaryexpert"],
    "AU": ["levels_fyi", "indeed", "robert_half", "salaryexpert"],
    "CH": ["levels_fyi", "indeed", "robert_half", "salaryexpert"],
    "AE": ["indeed", "levels_fyi", "robert_half", "salaryexpert"],
    "DE": ["levels_fyi", "indeed", "salaryexpert"],
    "FR": ["levels_fyi", "indeed", "salaryexpert"],
    "NL": ["levels_fyi", "indeed", "salaryexpert"],
    "ES": ["levels_fyi", "indeed", "salaryexpert"],
    "IT": ["levels_fyi", "indeed", "salaryexpert"],
}
DEFAULT_BENCHMARK_SOURCES = ["indeed", "levels_fyi", "salaryexpert"]
BENCHMARK_MAX_AGE_DAYS = 30
SIMILAR_JOBS_HEADINGS = [
    "Similar jobs", "People also viewed", "More searches",
    "Explore top content", "Show more jobs like this",
]
COMPETITIVE_PATTERN = (
    r"(?i)\b(competitive(\s+(salary|package|compensation))?|attractive\s+package|market[- ]leading)\b"
)
DOE_PATTERN = (
    r"(?i)(\bDOE\b|depends\s+on\s+experience|negotiable|£\s*negotiable|£\s*TBD"
    r"|to\s+be\s+discussed|\bTBD\b)"
)
OTE_WORDS = (
    r"(?:OTE|on-target|on target earnings|including commission|with bonus|inc\.\s+commission)"
)

# --- fixed values: retry --------------------------------------------------
NOT_FOUND_DAYS = {"exact": 14, "benchmark": 30}
MAX_TRANSIENT_ATTEMPTS = 5
BACKOFF_CAP_DAYS = 7
BREAKER_THRESHOLD = 3
MAX_KEY_ATTEMPTS = 3
RATE_WINDOW_SECONDS = 60
RATE_MAX_REQUESTS = 12
EMPTY_PAGE_STOP = 3

# --- fixed values: places and languages -----------------------------------
COUNTRY_NAMES = {
    "switzerland": "CH", "schweiz": "CH", "suisse": "CH", "svizzera": "CH",
    "germany": "DE", "deutschland": "DE", "france": "FR", "francia": "FR",
    "italy": "IT", "italia": "IT", "united kingdom": "GB", "uk": "GB",
    "great britain": "GB", "united states": "US", "usa": "US",
}
# (location text, code), first containing entry wins
LOCATION_COUNTRIES = [
    ("United Kingdom", "GB"), ("UK", "GB"), ("Great Britain", "GB"), ("Ireland", "IE"),
    ("Denmark", "DK"), ("Netherlands", "NL"), ("The Netherlands", "NL"),
]
HOST_PREFIX_COUNTRIES = {
    "uk.": "GB", "ie.": "IE", "ch.": "CH", "de.": "DE", "fr.": "FR", "nl.": "NL", "it.": "IT",
}
US_HOSTS = ["www.indeed.com", "indeed.com"]
LANGUAGE_ALIASES = {
    "english": "English", "englisch": "English", "anglais": "English", "inglese": "English",
    "german": "German", "deutsch": "German", "deutschkenntnisse": "German",
    "allemand": "German", "tedesco": "German",
    "french": "French", "français": "French", "francais": "French",
    "französisch": "French", "franzoesisch": "French", "francese": "French",
    "italian": "Italian", "italienisch": "Italian", "italien": "Italian", "italiano": "Italian",
}
# language -> words that name it; dictionary order is the output order
LANGUAGES = {
    "English": ["english"],
    "German": ["german", "deutsch"],
    "French": ["french", "français", "francais"],
    "Spanish": ["spanish", "español", "espanol", "castellano"],
    "Italian": ["italian", "italiano"],
    "Portuguese": ["portuguese", "português", "portugues"],
    "Dutch": ["dutch", "nederlands", "flemish"],
    "Danish": ["danish", "dansk"],
    "Swedish": ["swedish", "svenska"],
    "Norwegian": ["norwegian", "norsk"],
    "Finnish": ["finnish", "suomi"],
    "Polish": ["polish", "polski"],
    "Czech": ["czech", "čeština", "cestina"],
    "Slovak": ["slovak", "slovenčina"],
    "Hungarian": ["hungarian", "magyar"],
    "Romanian": ["romanian", "română", "romana"],
    "Bulgarian": ["bulgarian"],
    "Greek": ["greek", "ελληνικά"],
    "Turkish": ["turkish", "türkçe", "turkce"],
    "Russian": ["russian", "русский"],
    "Ukrainian": ["ukrainian", "українська"],
    "Arabic": ["arabic", "العربية"],
    "Hebrew": ["hebrew", "עברית"],
    "Hindi": ["hindi"],
    "Chinese": ["chinese", "mandarin", "cantonese", "中文", "普通话"],
    "Japanese": ["japanese", "日本語"],
    "Korean": ["korean", "한국어"],
}
PROFICIENCY = {
    "native": ["native", "mother tongue", "mothertongue", "bilingual", "madrelingua",
               "muttersprache", "langue maternelle"],
    "c2": ["c2", "proficient", "proficiency", "near-native", "near native"],
    "c1": ["c1", "fluent", "fluency", "advanced", "full professional",
           "professional working", "professional"],
    "b2": ["b2", "upper intermediate", "upper-intermediate", "working knowledge", "business"],
    "b1": ["b1", "intermediate", "conversational", "limited working"],
    "a2": ["a2", "elementary", "pre-intermediate"],
    "a1": ["a1", "basic", "beginner", "elementary proficiency"],
}
UNUSABLE_LEVELS = ["none", "no", "false", "a1", "a2", "basic", "beginner", "elementary"]
LEVEL_YES = ["yes", "true", "required", "granted", "have", "holder"]
LEVEL_NO = ["no", "false", "none", "not held", "no permit"]

# --- fixed values: requirement wording ------------------------------------
MANDATORY_PATTERN = (
    r"(?i)\b(required|must have|essential|strong background in|strong experience with|"
    r"significant experience with|deep experience with|deep knowledge of|"
    r"deep understanding of|proven experience in|proven track record with|"
    r"demonstrated experience with|hands-on experience with|hands-on expertise in|"
    r"expertise in|proficient in|solid experience with|you will work with|"
    r"you will use|you will be responsible for|experience with)\b"
)
NICE_PATTERN = (
    r"(?i)\b(nice to have|preferred|bonus|plus|optional|familiarity with|"
    r"exposure to|good to have|advantageous)\b"
)
AUTHORIZATION_PATTERN = (
    r"(?i)\b(work (authorization|authorisation|permit|visa)|visa sponsorship|"
    r"sponsorship (is )?(not )?(available|required|provided)|no sponsorship|"
    r"without (any )?sponsorship|citizen(n|ship)? (only|required)|"
    r"must (be|hold|be a|already hold)\b[^.;]{0,60}?(citizen|citizenship|work "
    r"authorization|clearance)|security clearance (required|mandatory)|"
    r"eligible to work\b|require[sd]? (a )?work (authorization|permit|visa))\b"
)
NO_SPONSORSHIP_PATTERN = (
    r"(?i)\b(no sponsorship (available|provided|offer(ed|ing))?|"
    r"without (any )?sponsorship|sponsorship is not available|"
    r"you (must|already) (be|hold|are))\b"
)
APPLICANT_ORIGIN_PATTERN = r"(?i)\b(candidates? (without|from)|applicants? (without|from))\b"
LANGUAGE_MUST_PATTERN = r"(?i)\b(fluent|fluency|proficient|proficiency|mandatory|required)\b"
LANGUAGE_NOT_PATTERN = r"(?i)\b(non[- ]native|not (fluent|required)|nice)\b"
REQUIREMENT_TAIL_PATTERN = r"\s+(?:is\s+)?(?:required|mandatory|essential|needed).*$"
REQUIREMENT_TOPIC_PATTERNS = [
    r"(?i)experience (?:with|in)\s+([a-zA-Z][\w\s./+#-]{1,40}?)(?=[,;.]|\sand\s|\sor\s|$)",
    r"(?i)knowledge of\s+([a-zA-Z][\w\s./+#-]{1,40}?)(?=[,;.]|\sand\s|\sor\s|$)",
]
MAX_CRITERIA = 12
MAX_PREFERRED = 8
DEFAULT_FIT_THRESHOLD = 60.0
LANGUAGE_NICE_CONTEXT = (
    r"(?i)\b(nice[- ]to[- ]have|plus|bonus|preferred|advantage|asset|optional|beneficial|"
    r"would be a plus|good to have|desirable)\b"
)
LANGUAGE_REQUIRED_CONTEXT = (
    r"(?i)\b(required|must|mandatory|essential|fluent|proficient|excellent|strong|native|"
    r"business fluent|c1|c2|kenntnisse|maîtrise|maitrise|obligatoire|nécessaire|necessaire|"
    r"erforderlich|voraussetzung|zwingend)\b"
)
LANGUAGE_GENERAL_CONTEXT = r"(?i)(language skills|sprachkenntnisse|langues?|languages?)"
PROXIMITY_REQUIRED = (
    "(must|required|mandatory|essential|fluent|proficient|native|business fluent|professional)"
)
PROXIMITY_NICE = (
    "(nice to have|preferred|bonus|plus|optional|advantage|good to have|desirable)"
)

# --- fixed values: portals and pages --------------------------------------
PORTAL_MARKERS = [
    "greenhouse", "lever.co", "workdayjobs", "myworkdayjobs", "ashbyhq", "smartrecruiters",
    "otta.com", "wellfound", "cord.co", "hackajob", "reed.co.uk", "totaljobs", "cwjobs",
    "irishjobs", "jobindex", "jobnet", "stepstone", "careers", "jobs", "join-us", "vacancies",
]
EXCLUDED_HOST_PATTERN = r"(?i)(^|\.)(linkedin\.com|indeed\.|glassdoor\.|monster\.|ziprecruiter\.)"
EXPIRED_PAGE_PATTERN = r"(?i)we can.?t find this page|page not found|error 404"
RESULT_MARKERS = (
    r'(?i)"job_id":\d+|/jobs/view/\d+|jobCardPrefetchQueries|totalResultSize|data-job-id=|'
    r"job-card-container"
)
DETAIL_MARKERS = r"(?i)Report this job|Seniority level|About the job|Employment type|Job function"
# (state, pattern), first match wins
BLOCK_SIGNATURES = [
    ("active_challenge", r"(?i)(?:captcha|recaptcha|hcaptcha).{0,120}(?:solve|verify|verification|challenge|continue)"),
    ("active_challenge", r"(?i)(?:solve|verify|verification|challenge).{0,120}(?:captcha|recaptcha|hcaptcha)"),
    ("active_challenge", r"(?i)please solve"),
    ("active_challenge", r"(?i)challenge[-_\s]?platform\b"),
    ("active_challenge", r"(?i)challenge[-_\s]?verification\b"),
    ("rate_limited", r"(?i)too many requests"),
    ("rate_limited", r"(?i)rate limit"),
    ("rate_limited", r"(?i)temporarily restricted"),
    ("blocked", r"(?i)security (?:verification|check)"),
    ("blocked", r"(?i)verify you.{0,40}(?:human|real person)"),
    ("blocked", r"(?i)are you a (?:real person|human)"),
    ("blocked", r"(?i)we.{0,30}detected.{0,30}(?:unusual|suspicious)"),
    ("blocked", r"(?i)unusual activity"),
    ("blocked", r"(?i)sign.?in to confirm you.{0,30}(?:real|not a bot)"),
]
RESTRICTION_STATES = ["active_challenge", "blocked", "rate_limited", "login_required"]
BREAKER_STATES = ["active_challenge", "blocked", "rate_limited"]
RUN_FAILURE_STATES = ["active_challenge", "blocked", "rate_limited", "failed"]
JD_START_PATTERN = (
    r"(?i)^(About|Responsibilities|Requirements|Job description|The Role|Role Overview|Your role|"
    r"What you|We are|We’re|Our client|Company Description|Minimum qualifications|"
    r"Basic qualifications|Overview|Locations?|Aufgaben|Profil|Deine|Ihre|Your mission)"
)
JD_END_PATTERN = (
    r"(?i)^(Show less$|Show more$|Seniority level$|Employment type$|Job function$|Industries$|"
    r"Skills$|Similar jobs$|People also viewed$|Set alert)"
)
JD_MARKERS = [
    ("Report this job", "Seniority level"), ("Report this job", "Employment type"),
    ("Report this job", "Show more"), ("About this job", "Show more"),
    ("About this job", "Show less"), ("About the job", "Show more"),
    ("About the job", "Show less"), ("Job description", "Show more"),
]
POSTED_LINE_PATTERN = r"(?i)\b(\d+\s+(minute|hour|day|week|month)s? ago|just now|reposted)\b"
# field -> ordered patterns, first match wins, group 1 is the value
FIELD_PATTERNS = {
    "title": [
        r'class="top-card-layout__title"[^>]*>([^<]+)<',
        r'class="job-details-jobs-v2__main-job-title">([^<]+)<',
        r'class="job-card-list__title"[^>]*>([^<]+)<',
        r'class="job-title"[^>]*>([^<]+)<',
    ],
    "company": [
        r'class="topcard__org-name-link"[^>]*>([^<]+)<',
        r'class="job-details-jobs-v2__company-name"[^>]*>([^<]+)<',
        r'class="job-card-list__company-name"[^>]*>([^<]+)<',
        r'class="company-name"[^>]*>([^<]+)<',
    ],
    "location": [
        r'class="topcard__flavor--bullet"[^>]*>([^<]+)<',
        r'class="job-details-jobs-v2__location"[^>]*>([^<]+)<',
        r'class="job-card-list__location"[^>]*>([^<]+)<',
        r'class="job-location"[^>]*>([^<]+)<',
    ],
    "applicants": [
        r'class="num-applicants__figure"[^>]*>(\d+)[^<]*<',
        r'class="job-card-list__applicant-count"[^>]*>(\d+)\s*applicants?',
        r'class="job-details-jobs-v2__applicant-count"[^>]*>(\d+)\s*applicants?',
        r"(?i)over\s+(\d+)\s*applicants?",
        r"(?i)(\d+)\+?\s*applicants?\s*(?:applied|have applied)?",
    ],
    "description": [
        r'(?s)class="description__text"[^>]*>(.*?)</div>',
        r'(?s)class="show-more-less__description"[^>]*>(.*?)</div>',
        r'(?s)class="job-card-list__description"[^>]*>(.*?)</div>',
    ],
    "recruiter": [
        r'class="hirer-name"[^>]*>([^<]+)<',
        r'class="recruiter-name"[^>]*>([^<]+)<',
    ],
    "posting_date": [
        r'class="job-posted-date"[^>]*>([^<]+)<',
        r'class="posted-date"[^>]*>([^<]+)<',
        r'class="posted-date"[^>]*datetime="([^"]+)"',
        r'class="job-posted-date"[^>]*datetime="([^"]+)"',
        r'class="job-details-jobs-v2__posted-date"[^>]*>([^<]+)<',
    ],
    "recruiter_email": [
        r'class="hirer-email"[^>]*>([^<]+)<',
        r'class="recruiter-email"[^>]*>([^<]+)<',
        r'(?s)class="hirer-info"[^>]*>.*?([\w.+-]+@[\w.-]+\.[a-zA-Z]{2,}).*?<',
        r'mailto:([^")]+)',
    ],
    "recruiter_profile_link": [
        r'class="hirer-name"[^>]*href="([^"]+)"',
        r'class="recruiter-name"[^>]*href="([^"]+)"',
        r'(?s)class="hirer-info"[^>]*>.*?class="hirer-name"[^>]*href="([^"]+)"',
    ],
}
APPLY_LINK_PATTERNS = [
    r'class="apply-link"[^>]*href="([^"]+)"',
    r'class="apply-link external"[^>]*href="([^"]+)"',
    r'class="apply-button"[^>]*href="([^"]+)"',
]
JOB_ID_PATTERNS = [
    r'"job_id":(\d+)',
    r"/jobs/view/(\d+)",
    r"(?i)urn:li:[^:\"']*job[^:\"']*:(\d+)",
    r"fsd_jobPostingCard:\((\d+),",
]
SLUG_ALIASES = {
    "ai architect": "artificial intelligence architect",
    "ai solution architect": "artificial intelligence architect",
    "ai solutions architect": "artificial intelligence architect",
    "genai architect": "artificial intelligence architect",
    "generative ai architect": "artificial intelligence architect",
    "enterprise ai architect": "artificial intelligence architect",
    "ai platform architect": "artificial intelligence architect",
    "ai engineer": "artificial intelligence",
    "ai lead": "artificial intelligence",
    "solution architect": "solutions architect",
}

# --- fixed values: title normalization ------------------------------------
NORMALIZER_VERSION = 1
COMPOUND_PHRASES = {
    "c++": "cpp", "c#": "csharp", ".net": "dotnet",
    "machine learning": "machine_learning",
    "artificial intelligence": "artificial_intelligence",
    "natural language processing": "natural_language_processing",
    "site reliability engineer": "sre",
    "software engineer": "software_engineer",
    "solutions architect": "solutions_architect",
    "backend engineer": "backend_engineer",
    "frontend engineer": "frontend_engineer",
    "frontend developer": "frontend_engineer",
    "full stack engineer": "full_stack_engineer",
    "senior engineer": "senior_engineer",
    "principal engineer": "principal_engineer",
    "staff engineer": "staff_engineer",
    "engineering manager": "engineering_manager",
    "technical lead": "technical_lead",
    "product manager": "product_manager",
    "project manager": "project_manager",
    "quality assurance": "quality_assurance",
    "user experience": "user_experience",
    "user interface": "user_interface",
    "cloud architect": "cloud_architect",
    "security engineer": "security_engineer",
    "network engineer": "network_engineer",
    "database administrator": "database_administrator",
    "systems administrator": "systems_administrator",
    "business analyst": "business_analyst",
    "systems engineer": "systems_engineer",
    "solutions engineer": "solutions_engineer",
    "technical architect": "technical_architect",
    "senior manager": "senior_manager",
    "vice president": "vice_president",
    "chief executive": "chief_executive",
    "chief financial": "chief_financial",
    "chief technology": "chief_technology",
    "chief operating": "chief_operating",
    "senior architect": "senior_architect",
    "lead architect": "lead_architect",
}
TITLE_SYNONYMS = {
    "sr": "senior", "sr.": "senior", "jr": "junior", "jr.": "junior",
    "eng": "engineer", "engr": "engineer", "engineers": "engineer",
    "swe": "software_engineer", "mgr": "manager", "managers": "manager",
    "dev": "developer", "developers": "developer", "vp": "vice_president",
    "ai": "artificial_intelligence", "ml": "machine_learning",
    "nlp": "natural_language_processing", "ui": "user_interface", "ux": "user_experience",
    "devops": "development_operations",
    "i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5",
    "développeur": "developer", "desarrollador": "developer", "entwickler": "developer",
    "architekt": "architect", "architetto": "architect", "architeto": "architect",
    "ingeniero": "engineer", "ingegnere": "engineer",
}
TITLE_STOPWORDS = ["a", "an", "the", "of", "for", "at", "in", "with", "and", "or", "to"]
TITLE_FILLERS = ["experienced", "seasoned", "talented", "passionate", "motivated"]
REMOTE_WORDS = ["remote", "hybrid", "on-site", "onsite", "wfh"]
LOCATION_WORDS = [
    "london", "manchester", "edinburgh", "glasgow", "dublin", "paris", "berlin", "munich",
    "geneva", "amsterdam", "madrid", "barcelona", "milan", "rome", "stockholm", "copenhagen",
    "oslo", "helsinki", "warsaw", "prague", "vienna", "brussels", "lisbon", "new_york",
    "san_francisco", "los_angeles", "seattle", "boston", "chicago", "austin", "denver",
    "toronto", "vancouver", "montreal", "sydney", "melbourne", "tokyo", "singapore",
    "hong_kong", "bangalore", "mumbai", "dubai", "abu_dhabi", "uk", "usa", "eu", "emea",
    "apac", "na",
]
# first bucket with a matching word wins
SENIORITY_TABLE = [
    ("cxo", ["cxo", "ceo", "cfo", "cto", "coo", "chief", "chief_executive", "chief_financial",
             "chief_technology", "chief_operating"]),
    ("vp", ["vp", "vice_president", "vice president", "vice"]),
    ("director", ["director", "directeur", "direktor", "direttore"]),
    ("manager", ["manager", "mgr", "management", "managing", "engineering_manager",
                 "product_manager", "project_manager", "senior_manager"]),
    ("lead", ["lead", "tech_lead", "technical_lead"]),
    ("principal", ["principal", "principal_engineer"]),
    ("staff", ["staff", "staff_engineer"]),
    ("senior", ["senior", "sr", "senior_engineer", "sr.", "iii", "iv", "v"]),
    ("mid", ["mid", "mid_level", "intermediate", "intermediate_level"]),
    ("junior", ["junior", "jr", "jr.", "junior_engineer", "entry_level", "entry"]),
    ("intern", ["intern", "internship", "trainee", "apprentice"]),
]
# first code with a matching word wins
INDUSTRY_TABLE = [
    ("finance", ["finance", "banking", "investment", "trading", "hedge_fund", "fintech", "capital",
                 "securities", "forex", "crypto", "blockchain", "financial", "payment", "lending"]),
    ("healthcare", ["healthcare", "medical", "hospital", "pharmacy", "clinical", "health", "doctor",
                    "nurse", "physician", "surgery", "dental", "mental", "wellness",
                    "telemedicine", "biomedical"]),
    ("biotech", ["biotech", "biotechnology", "pharmaceutical", "pharma", "drug", "clinical_trial",
                 "research", "lab", "laboratory", "genetics", "dna", "rna", "protein", "cell",
                 "tissue", "immunology", "oncology"]),
    ("manufacturing", ["manufacturing", "factory", "industrial", "production", "operations",
                       "supply_chain", "logistics", "assembly", "warehouse", "distribution",
                       "fabrication", "automotive", "aerospace"]),
    ("retail", ["retail", "ecommerce", "commerce", "shopping", "store", "customer_service",
                "merchandising", "inventory", "sales", "point_of_sale", "pos", "buying"]),
    ("education", ["education", "school", "university", "college", "academic", "training", "course",
                   "teaching", "instructor", "professor", "curriculum", "lms"]),
    ("consulting", ["consulting", "advisory", "strategy", "management_consulting",
                    "business_consulting", "it_consulting", "technical_consulting",
                    "engagement", "client"]),
    ("government", ["government", "public_sector", "federal", "state", "municipal", "local",
                    "civic", "military", "defense", "administration"]),
    ("media", ["media", "publishing", "entertainment", "broadcast", "television", "tv", "film",
               "movie", "news", "journalism", "content", "creative", "design", "art", "music",
               "studio"]),
    ("energy", ["energy", "power", "oil", "gas", "petroleum", "renewable", "solar", "wind",
                "utility", "electricity", "coal", "nuclear", "utilities", "hydro"]),
    ("telecom", ["telecom", "telecommunications", "wireless", "mobile", "carrier", "5g", "4g",
                 "network", "infrastructure", "isp", "internet_service"]),
    ("transportation", ["transportation", "logistics", "freight", "shipping", "delivery",
                        "supply_chain", "automotive", "airline", "aviation", "maritime", "rail",
                        "railroad", "vehicle", "truck"]),
    ("insurance", ["insurance", "underwriting", "claims", "policy", "actuarial",
                   "risk_management", "reinsurance", "adjuster", "broker", "agent"]),
    ("software", ["software", "saas", "edtech", "platform", "cloud", "programming", "api",
                  "framework", "library", "application", "web", "mobile", "backend", "frontend",
                  "devops", "data", "full stack", "fullstack", "full_stack", "database", "sql",
                  "nosql", "python", "java", "javascript", "typescript", "ruby", "php", "golang",
                  "rust", "cpp", "csharp", "kotlin", "swift", "scala", ".net", "dotnet"]),
]
