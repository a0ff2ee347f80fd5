"""Columns, labels and orders of the yearly developer survey.

All values below are fixed values: they have to equal the survey's own texts, byte
for byte. Mind the typographic apostrophe (U+2019) in the education and organisation
labels.
"""

from __future__ import annotations

KEY = "ResponseId"
TARGET = "ConvertedCompYearly"
LOG_TARGET = "log_salary"

REQUIRED_COLUMNS = (
    "ResponseId", "YearsCode", "YearsCodePro", "ConvertedCompYearly", "LanguageHaveWorkedWith",
    "RemoteWork", "Age", "EdLevel", "DevType", "Country", "Employment", "OrgSize", "WorkExp",
    "Industry", "ICorPM", "JobSat", "JobSatPoints_1", "JobSatPoints_4", "JobSatPoints_5",
    "JobSatPoints_6", "JobSatPoints_7", "JobSatPoints_8", "JobSatPoints_9", "JobSatPoints_10",
    "JobSatPoints_11", "Knowledge_1", "Knowledge_2", "Knowledge_3", "Knowledge_4", "Knowledge_5",
    "Knowledge_6", "Knowledge_7", "Knowledge_8", "Knowledge_9",
)

YEAR_BOUNDARIES = {"Less than 1 year": 0.5, "More than 50 years": 51.0}

LIKERT_SCORES = {
    "Strongly disagree": -2,
    "Disagree": -1,
    "Neither agree nor disagree": 0,
    "Agree": 1,
    "Strongly agree": 2,
}
AGE_LEVELS = (
    "Under 18 years old",
    "18-24 years old",
    "25-34 years old",
    "35-44 years old",
    "45-54 years old",
    "55-64 years old",
    "65 years or older",
)
EDUCATION_LEVELS = (
    "Primary/elementary school",
    "Secondary school (e.g. American high school, German Realschule or Gymnasium, etc.)",
    "Some college/university study without earning a degree",
    "Associate degree (A.A., A.S., etc.)",
    "Bachelor’s degree (B.A., B.S., B.Eng., etc.)",
    "Master’s degree (M.A., M.S., M.Eng., MBA, etc.)",
    "Professional degree (JD, MD, Ph.D, Ed.D, etc.)",
)
ORGANISATION_LEVELS = (
    "Just me - I am a freelancer, sole proprietor, etc.",
    "2 to 9 employees",
    "10 to 19 employees",
    "20 to 99 employees",
    "100 to 499 employees",
    "500 to 999 employees",
    "1,000 to 4,999 employees",
    "5,000 to 9,999 employees",
    "10,000 or more employees",
)
# Column -> (display name, levels from low to high, answers that count as no answer).
ORDINAL_QUESTIONS = {
    "Age": ("Age", AGE_LEVELS, ("Prefer not to say",)),
    "EdLevel": ("Education level", EDUCATION_LEVELS, ("Something else",)),
    "OrgSize": ("Organization size", ORGANISATION_LEVELS, ("I don’t know",)),
}

KNOWLEDGE = tuple(f"Knowledge_{i}" for i in range(1, 10))
KNOWLEDGE_SCORES = tuple(f"{name}_score" for name in KNOWLEDGE)
ORDINAL_SCORES = tuple(f"{name}_order" for name in ORDINAL_QUESTIONS)
EXPERIENCE = ("YearsCode_num", "YearsCodePro_num", "WorkExp_num")
EXPERIENCE_DERIVED = (
    "ProfessionalExperienceRatio",
    "PreProfessionalCodingYears",
    "WorkProfessionalGapYears",
)
NUMERIC_CANDIDATES = EXPERIENCE + KNOWLEDGE_SCORES
POINT_COLUMNS = tuple(f"JobSatPoints_{i}" for i in (1, 4, 5, 6, 7, 8, 9, 10, 11))
MATRIX_LABELS = {
    "YearsCode_num": "Years coding",
    "YearsCodePro_num": "Professional years",
    "WorkExp_num": "Work experience",
    "JobSat": "Job satisfaction",
    "JobSatPoints_1": "Team strategy",
    "JobSatPoints_4": "Open source",
    "JobSatPoints_5": "Security",
    "JobSatPoints_6": "Code quality",
    "JobSatPoints_7": "New technology",
    "JobSatPoints_8": "Architecture",
    "JobSatPoints_9": "Tool expertise",
    "JobSatPoints_10": "Hardware",
    "JobSatPoints_11": "Network / observability",
    **{name: f"Knowledge {i}" for i, name in enumerate(KNOWLEDGE_SCORES, start=1)},
    "log_salary": "Log annual income",
}
MATRIX_COLUMNS = tuple(MATRIX_LABELS)

CATEGORY_FEATURES = ("Country", "DevType", "RemoteWork", "EdLevel")
NOMINAL_FEATURES = ("Country", "DevType", "RemoteWork", "Industry", "ICorPM")
TOP_CATEGORY_FEATURES = ("Country", "DevType")
EMPLOYMENT = "Employment"
REMOTE_COLUMN, REMOTE, IN_PERSON = "RemoteWork", "Remote", "In-person"

MODEL_NUMERIC = NUMERIC_CANDIDATES + ORDINAL_SCORES + EXPERIENCE_DERIVED
MODEL_NOMINAL = ("Age", "Country", "DevType", "RemoteWork", "EdLevel", "OrgSize", "Industry", "ICorPM")
MODEL_MULTISELECT = (
    "Employment",
    "CodingActivities",
    "LanguageHaveWorkedWith",
    "DatabaseHaveWorkedWith",
    "PlatformHaveWorkedWith",
    "ProfessionalTech",
)
DESCRIBED_COLUMNS = (*NUMERIC_CANDIDATES, *ORDINAL_SCORES, TARGET, LOG_TARGET)
CLEANED_COLUMNS = (
    KEY, TARGET, LOG_TARGET, *EXPERIENCE, *EXPERIENCE_DERIVED, *KNOWLEDGE, *KNOWLEDGE_SCORES,
    *ORDINAL_SCORES, "Country", "DevType", "RemoteWork", "EdLevel", "Employment", "OrgSize", "Age",
    "Industry", "ICorPM",
)
