"""Word lists and lookup tables of the clinical vocabulary."""

# These lists have to be exactly as they are for results to agree.

#: Term -> related terms added to a query.
SYNONYMS = {
    "sugar": ["glucose", "hba1c", "diabetes"], "diabetic": ["diabetes", "hba1c", "glucose"], "bp": [
        "blood", "pressure", "systolic", "hypertension",
    ],
    "pressure": ["hypertension", "systolic"], "kidney": [
        "renal", "creatinine", "egfr", "ckd",
    ], "renal": ["kidney", "creatinine", "egfr"],
    "thyroid": ["tsh", "hypothyroidism", "levothyroxine"], "heart": ["cardiac", "coronary", "troponin", "ldl"],
    "cholesterol": [
        "ldl", "lipid", "statin", "atorvastatin",
    ], "lung": ["copd", "asthma", "spo2", "inhaler"], "breathing": ["asthma", "copd", "spo2", "wheeze"],
    "anemia": ["hemoglobin", "ferritin", "iron"], "joint": [
        "arthritis", "crp", "esr", "methotrexate",
    ], "mood": ["depression", "phq-9", "sertraline"],
    "allergy": ["allergies", "allergic"], "allergic": ["allergies"], "drugs": [
        "medications", "medication",
    ], "medicines": ["medications", "medication"],
    "meds": [
        "medications", "medication",
    ], "tests": ["lab", "result"], "labs": ["lab", "result"], "admitted": ["admission", "discharge"],
    "hospitalised": ["admission", "discharge"], "hospitalized": ["admission", "discharge"],
}

#: Words that are no tokens.
STOP = [
    "the", "a", "an", "of", "and", "or", "is", "are", "was", "were", "to", "for", "in", "on", "at", "with",
    "what", "which", "who", "how", "does", "do", "did", "has", "have", "had", "this", "that", "patient", "me",
    "show", "tell", "give", "any", "all", "from", "by", "be", "been", "his", "her", "their", "latest", "recent",
]

#: Words that say nothing about what a question is after.
EXTRA_STOP = [
    "result", "results", "value", "values", "status", "current", "history", "information", "info", "details",
    "summary", "there", "while", "also", "please", "about", "record", "records", "level", "levels", "number",
    "numbers", "reading", "readings", "found", "mentioned", "documented", "using", "taking", "currently",
    "last", "past", "since", "over", "within", "months", "month", "years", "year", "weeks", "week", "days",
]

#: Condition -> other names.
CONDITION_ALIASES = {
    "Type 2 Diabetes Mellitus": ["type 2 diabetes", "diabetes", "diabetic", "t2dm"],
    "Essential Hypertension": ["hypertension", "hypertensive", "high blood pressure", "htn"],
    "Chronic Kidney Disease Stage 3": ["chronic kidney disease", "kidney disease", "ckd", "renal disease"],
    "Hypothyroidism": ["hypothyroidism", "hypothyroid", "underactive thyroid"],
    "Asthma": ["asthma", "asthmatic"],
    "Coronary Artery Disease": ["coronary artery disease", "coronary", "cad", "heart disease", "ischemic heart"],
    "Iron Deficiency Anemia": ["iron deficiency", "anemia", "anaemia", "anemic"],
    "Chronic Obstructive Pulmonary Disease": ["copd", "chronic obstructive", "emphysema"],
    "Rheumatoid Arthritis": ["rheumatoid", "arthritis"],
    "Major Depressive Disorder": ["depression", "depressive", "depressed", "mdd"],
    "Hyperlipidemia": ["hyperlipidemia", "hyperlipidaemia", "high cholesterol", "dyslipidemia"],
}

#: Laboratory test -> names it goes by.
LAB_ALIASES = {
    "HbA1c": ["hba1c", "a1c", "glycated hemoglobin", "glycosylated"],
    "Fasting Glucose": ["fasting glucose", "blood glucose", "glucose", "blood sugar", "fasting sugar"],
    "Systolic BP": [
        "systolic bp", "systolic",
    ], "Serum Potassium": ["potassium"], "Creatinine": ["creatinine"], "eGFR": ["egfr", "gfr"],
    "TSH": ["tsh", "thyroid stimulating"], "Peak Flow": ["peak flow"], "LDL Cholesterol": ["ldl cholesterol", "ldl"],
    "Total Cholesterol": [
        "total cholesterol", "cholesterol",
    ], "Troponin I": ["troponin"], "Hemoglobin": ["hemoglobin", "haemoglobin"],
    "Ferritin": ["ferritin"], "SpO2": [
        "spo2", "oxygen saturation", "oxygen level", "saturation",
    ], "FEV1/FVC": ["fev1/fvc", "fev1", "spirometry"],
    "CRP": ["crp", "c-reactive"], "ESR": ["esr"], "PHQ-9 Score": ["phq-9", "phq9"],
}

#: Class word -> base names of its drugs.
DRUG_CLASSES = {
    "statin": ["atorvastatin"], "statins": ["atorvastatin"], "arb": [
        "losartan", "telmisartan",
    ], "arbs": ["losartan", "telmisartan"],
    "beta blocker": ["metoprolol"], "beta blockers": ["metoprolol"], "beta-blocker": ["metoprolol"],
    "sulfonylurea": ["glimepiride"], "sulfonylureas": ["glimepiride"], "diuretic": [
        "hydrochlorothiazide"
    ], "diuretics": ["hydrochlorothiazide"],
    "antidepressant": ["sertraline"], "antidepressants": ["sertraline"],
}
INHALER_WORDS = ["inhaler", "inhalers"]
INHALED = ["salbutamol", "budesonide", "tiotropium", "formoterol"]

#: Allergen word -> how records spell it.
ALLERGENS = {
    "penicillin": "penicillin", "sulfa": "sulfa", "latex": "latex", "shellfish": "shellfish", "nsaid": "nsaids",
    "nsaids": "nsaids",
}

#: Symptom -> regular expressions for it.
SYMPTOMS = {
    "increased thirst": [
        "increased thirst", "polydipsia",
    ], "frequent urination": ["frequent urination", "polyuria"], "blurred vision": ["blurred vision"],
    "fatigue": [
        "fatigue", "fatigability", "tiredness",
    ], "headache": ["headaches?"], "dizziness": ["dizziness"], "chest pain": ["chest pain", "chest discomfort"],
    "breathlessness": [
        "breathlessness", "shortness of breath",
    ], "ankle swelling": ["ankle swelling"], "reduced urine output": ["reduced urine output", "oliguria"],
    "nocturia": ["nocturia"], "cold intolerance": [
        "cold intolerance"
    ], "weight gain": ["weight gain"], "constipation": ["constipation"], "dry skin": ["dry skin"],
    "cough": ["cough"], "wheeze": [
        "wheeze", "wheezing",
    ], "chest tightness": ["chest tightness"], "pallor": ["pallor"], "palpitations": ["palpitations"],
    "morning stiffness": [
        "morning stiffness"
    ], "joint swelling": ["joint swelling"], "low mood": ["low mood"], "poor sleep": ["poor sleep"],
    "reduced appetite": ["reduced appetite"], "anhedonia": ["anhedonia"],
}

NSAID_LIKE = ["aspirin", "ibuprofen", "diclofenac", "naproxen"]
RAAS = ["losartan", "telmisartan", "enalapril", "ramipril"]

#: Two-sided 95 % quantiles of Student's t by degrees of freedom; beyond them NORMAL_95.
T_95 = {1: 12.71, 2: 4.30, 3: 3.18, 4: 2.78, 5: 2.57, 6: 2.45, 7: 2.36, 8: 2.31, 9: 2.26, 10: 2.23}
NORMAL_95 = 1.96

# Patterns that classify questions.
TREND_WORDS = r"(trend|trajectory|over time|changing|changed|progress|rising|falling|worsen|worse|improv|forecast|predict|projection|next)"
ALERT_WORDS = r"(alert|danger|unsafe|safe|interaction|conflict|concern|warning|contraindic|red flag|risk)"
RISK_WORDS = r"(risk|complexity|severity|how sick|priority)"
MED_WORDS = r"(medicat|medicine|drug|meds|prescri|dose|tablet|inhaler)"
LAB_WORDS = r"(lab|result|test|level|value|hba1c|creatinine|egfr|tsh|glucose|ldl|hemoglobin|crp|esr|potassium|spo2)"
ENC_WORDS = r"(admit|admission|discharge|hospital|visit|encounter|emergency)"
COHORT_WORDS = r"(which patients|which people|who has|who have|who is|who are|how many|list (?:all )?patients|patients (?:with|on|who|taking|having)|all patients|cohort)"
NOTE_WORDS = r"symptom|complain|present|note|report|denies"
NEGATIONS = r"\b(no|denies|denied|without|negative for|not|absent|free of|ruled out|nil)\b"
TERMINATORS = r"\b(but|however|although|though|except|apart from|aside from)\b"
ABNORMAL_WORDS = r"\b(abnormal|high|elevated|raised|low|reduced|poor|uncontrolled|out of range)\b"
ANSWER_INTENTS = {
    "allergy": r"\b(allerg|allergic)",
    "medication": r"\b(medicat|drug|meds|prescri|taking|dose)",
    "lab": r"\b(lab|result|hba1c|creatinine|tsh|glucose|egfr|ldl|hemoglobin|crp|test)",
    "encounter": r"\b(admit|admission|discharge|hospital|visit|encounter)",
}
KIND_FOR_INTENT = {"lab": "lab", "medication": "medication", "allergy": "profile", "encounter": "encounter"}

# Patterns of what identifies a person.
PHONE = r"\+?\d[\d\-\s]{8,}\d"
EMAIL = r"[\w.+-]+@[\w-]+\.[\w.-]+"
RECORD_ID = r"\bAUR-\d{6}\b"
CLINICIAN = r"\bDr\.\s+[A-Z][a-z]+"

# End of the fixed values.
