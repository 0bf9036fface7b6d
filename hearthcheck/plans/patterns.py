"""Fixed values of the survey domain: name patterns, keyword lists, code values and bounds.

They decide which column or table plays which role, so they must stay exactly as the
field teams' dictionary has them. Nothing in this module touches data.
"""

import re

# --- Fixed values: column roles, matched anywhere in the name unless anchored -----------
PERSON_NAME = re.compile(r"(nom|name|prenom|prénom|surname|firstname|lastname)", re.IGNORECASE)
IDENTIFIER = re.compile(r"(id|identif)", re.IGNORECASE)
AGENT = re.compile(
    r"(field_?wrkr|fieldworker|agent_?id|agent_?name|^agent$|agent_?enquet|interviewer_?id)", re.IGNORECASE
)
CONTROLLER = re.compile(
    r"(controleur|contr[oô]lleur|superviseur|supervisor|chef_?equipe|team_?lead|^contro$)", re.IGNORECASE
)
VISIT_ID = re.compile(r"(enquete_?id|enquete_?or_?visite_?id|visite_?id)", re.IGNORECASE)
EMAIL = re.compile(r"(email|e_?mail|courriel)", re.IGNORECASE)
BIRTH_DATE = re.compile(r"(birth_date|naissance)", re.IGNORECASE)
DEATH_DATE = re.compile(r"(death_date|evtdate|deces|dcd)", re.IGNORECASE)
ARRIVAL_DATE = re.compile(r"arrive.*date|date.*arrive", re.IGNORECASE)
DEPARTURE_DATE = re.compile(r"depart.*date|date.*depart", re.IGNORECASE)
ENTRY_DATE = re.compile(r"(entry_date|date.*enregistr)", re.IGNORECASE)
WEIGHT = re.compile(r"(poids|weight)", re.IGNORECASE)
HEIGHT = re.compile(r"(taille|height)", re.IGNORECASE)
MOTHER_ID = re.compile(r"(motherid|mereid|id_mere)", re.IGNORECASE)
FATHER_ID = re.compile(r"(fatherid|pereid|id_pere)", re.IGNORECASE)
LATITUDE = re.compile(r"^lat(itude)?$", re.IGNORECASE)
LONGITUDE = re.compile(r"^lon(g|gitude)?$", re.IGNORECASE)
PHONE = re.compile(r"(telephone|numtel|phone)", re.IGNORECASE)
SLEPT = re.compile(r"(sleep|dormi)", re.IGNORECASE)
PLACE = re.compile(r"(locationid|menageid)", re.IGNORECASE)
HOUSEHOLD = re.compile(r"(socialgpid)", re.IGNORECASE)
UNION_AGE = re.compile(r"union_?age", re.IGNORECASE)
DIED_IN_FACILITY = re.compile(r"diedinhs", re.IGNORECASE)
WENT_TO_FACILITY = re.compile(r"gonetohs", re.IGNORECASE)
HEAD_RELATION = re.compile(r"rltn_?head", re.IGNORECASE)
PREGNANCY_OUTCOME_ID = re.compile(r"pregoutid", re.IGNORECASE)
EVENT_ID = re.compile(r"^eventid$", re.IGNORECASE)
PREGNANCY_EVENT_ID = re.compile(r"^peventid$", re.IGNORECASE)
ANTENATAL_DATE = re.compile(r"^cpn_?date(\d+)$", re.IGNORECASE)
ANTENATAL_COUNT = re.compile(r"nb_?cpn", re.IGNORECASE)
RESPONDENT_ID = re.compile(r"^respondid$", re.IGNORECASE)
MENSES = re.compile(r"^S4_2$", re.IGNORECASE)
MENSES_MONTH = re.compile(r"^S4_2mm$", re.IGNORECASE)
INTERNET_USE = re.compile(r"^S5_1$", re.IGNORECASE)
INTERNET_PLACE = re.compile(r"^S5_2[ABC]$", re.IGNORECASE)
RESIDENCE_STATUS = re.compile(r"res_?status", re.IGNORECASE)
BEGIN_TIME = re.compile(r"begin_?time", re.IGNORECASE)
END_TIME = re.compile(r"end_?time", re.IGNORECASE)
GENDER = re.compile(r"^gender$", re.IGNORECASE)
LIVING_CHILDREN = re.compile(r"living_?children_?number", re.IGNORECASE)
CHILD_ALIVE = re.compile(r"^isAlive$", re.IGNORECASE)
CHILD_BIRTH_DATE = re.compile(r"^birthDate$", re.IGNORECASE)
ETHNIC_GROUP = re.compile(r"^ethnic_gp$", re.IGNORECASE)
UNION_DATES = {
    "start": re.compile(r"uni_?start_?date", re.IGNORECASE),
    "civil": re.compile(r"uni_?civil_?date", re.IGNORECASE),
    "religious": re.compile(r"uni_?relig_?date", re.IGNORECASE),
    "traditional": re.compile(r"uni_?trad_?date", re.IGNORECASE),
}

# --- Fixed values: columns documented as real identifiers, the only ones to join on -----
DOCUMENTED_KEYS = frozenset(
    {
        "individid", "socialgpid", "locationid", "episodeid", "episodeid_res", "episodeid_head",
        "eventid", "observeid", "sobserveid", "eobserveid", "fatherid", "motherid", "headid",
        "individid2", "childid", "ownerid", "owner_id", "pregoutid", "respondid", "srespondid",
        "erespondid", "peventid", "accomid", "chiefid", "socialgpidtmp", "lobserveid", "slobserveid",
        "elobserveid", "region", "cluster", "shusb_region", "shusb_locationid", "ehusb_region",
        "ehusb_locationid", "swife_region", "swife_locationid", "ewife_region", "ewife_locationid",
    }
)

# --- Fixed values: technical prefixes in front of table names ---------------------------
TABLE_PREFIXES = ("fnew_", "fnew", "f_new_", "f_new")

# --- Fixed values: keywords that give a table its role ----------------------------------
PERSON_TABLE = ("individual", "individu")
PRESENCE_TABLE = ("presences", "presence")
DEATH_TABLE = ("death", "deces")
BIRTH_TABLE = ("birth", "naissance")
EDUCATION_TABLE = ("education",)
EMPLOYMENT_TABLE = ("emploi", "employ")
PREGNANCY_TABLE = ("pregnancy", "grossesse")
NOT_PREGNANCY_TABLE = ("cpn", "outcome", "issue")
OUTCOME_TABLE = ("pregoutcome", "issuegrossesse", "issue_grossesse")
ANTENATAL_TABLE = ("cpn",)
REPRODUCTIVE_TABLE = ("genesiq", "gnesiq")
REPRODUCTIVE_COMPLEMENT_TABLE = ("gnesiqcompl", "genesiqcompl", "genesiquecomplementaire")
TELEPHONE_TABLE = ("telephone",)
POVERTY_TABLE = ("pauvrete",)
HEALTH_TABLE = ("sante",)
UNION_TABLE = ("histmat", "matrimon", "union", "marietal")
UNION_HISTORY_TABLE = ("histmat", "matrimon", "marietal")
RELATIONSHIP_TABLE = ("relationship", "relation")
DEPARTURE_TABLE = ("migration_out", "migrationout", "depart")
ARRIVAL_TABLE = ("migration_in", "migrationin")
OBSERVATION_TABLE = ("observation",)
SNAKEBITE_TABLE = ("snakebite",)
NOT_SNAKEBITE_TABLE = ("snakebiteanimaux", "snakebiteindividus")
RESIDENCY_TABLE = ("residency", "residence")
VISIT_TABLE = ("enquete", "visite")
USER_TABLE = ("users", "utilisateurs", "user")

# --- Fixed values: age brackets expected by form ----------------------------------------
AGE_BRACKETS = (
    (REPRODUCTIVE_TABLE, 12.0, 49.0),
    (EDUCATION_TABLE, 5.0, 34.0),
    (EMPLOYMENT_TABLE, 15.0, 120.0),
    (PREGNANCY_TABLE, 12.0, 49.0),
)

# --- Fixed values: codes, sentinels and bounds ------------------------------------------
HEAD_CODE = "1"
RESIDENT_CODE = "1"
MALE_CODE = "1"
FEMALE_CODE = "2"
NO_CODE = "2"
NEVER_CODE = "7"
USED_CODES = ("1", "2", "3", "4")
SEX_CODES = ("1", "2")
ETHNIC_CODES = tuple(str(code) for code in range(1, 14))
MISSING_WEIGHT = 9999.0
MISSING_HEIGHT = 99.0
LATITUDE_RANGE = (9.0, 15.2)
LONGITUDE_RANGE = (-5.6, 2.5)
UNION_AGE_RANGE = (12.0, 40.0)
CHILD_BIRTH_YEARS = (2022, 2026)
YOUNG_CHILD_AGE = 5.0
HEAD_MINIMUM_AGE = 12.0
ADULT_AGE = 15.0
MENSES_AGE = 35.0
MOTHER_MINIMUM_AGE = 15.0
PARENT_AGE_GAP = 12.0
UNION_AGE_GAP = 3.0
SHORT_INTERVIEW_MINUTES = 3.0
EARLIEST_DATE = "1900-01-01"
LIST_CAP = 50
SQL_ROW_CAP = 200
SAMPLE_SIZE = 100
SAMPLE_SEED = 20260729
DATE_SHARE = 0.7

# --- Fixed values: field-work volume categories, in the order they are tried ------------
DISTINCT_HOUSEHOLDS = "Ménages/UCH distincts"
VOLUME_CATEGORIES = (
    ("Ménages/UCH visités", PRESENCE_TABLE),
    ("Naissances enregistrées", BIRTH_TABLE),
    ("Décès enregistrés", DEATH_TABLE),
    ("Grossesses enregistrées", PREGNANCY_TABLE),
)
OTHER_FORMS = "Autres fiches ({table})"
NOT_GIVEN = "Non renseigné"
GOAL = 17000

# --- Fixed values: retrieval ------------------------------------------------------------
MAX_DOCUMENT_SHARE = 0.9
TOP_PASSAGES = 5
PRIORITY_BOOST = 1.5
WEAK_SCORE = 0.12
HISTORY_TURNS = 6

# How a turn gives a goal, an identifier or a list of agents, and the words before an ambiguous alias.
GOAL_NUMBER = r"objectif\D{0,15}?(\d[\d\s.,]*)"
LONE_NUMBER = r"(?U)\b(\d+)\b"
IDENTIFIER_WORD = r"[A-Za-z0-9_\-]{3,}"
EXCLUDE_AGENTS = r"(?U)exclu\w*|sans les agents?|hors agents?"
AGENT_LIST = r"(?U)agents?\s*[:\-]?\s*(\w[\w,\s]*)$"
LIST_SEPARATOR = r"[,;]| et "
ARTICLE = r"(?:la\s+|le\s+|les\s+|l['’]\s*|de\s+la\s+|des\s+)?"
SHORTEST_ALIAS = 4
