"""Fixed values of the admissions domain: column names, header spellings, code lists and labels.

Nothing here is computed from data. The tables are small by nature (tens of
entries), so the engine folds them into expressions instead of joining them.
"""

from __future__ import annotations

# --- fixed values: columns -------------------------------------------------

DISABILITY = "tipodedeficiência"
BALANCE = "saldomovimentação"

CUBE_KEYS = [
    "data",
    "municipio",
    "cnae20subclasse",
    "grau_instrucao",
    "genero",
    "raca_cor",
    DISABILITY,
]
GROUP_KEYS = CUBE_KEYS[1:]
CUBE_MEASURES = ["soma_salario", "soma_idade", "total_admissoes"]

# canonical source column -> name in the clean data set, in output order
REQUIRED_COLUMNS = {
    "competênciamov": "competencia_mov",
    "município": "municipio",
    "cnae20subclasse": "cnae20subclasse",
    "cbo2002ocupação": "cbo2002ocupacao",
    "graudeinstrução": "grau_instrucao",
    "idade": "idade",
    "raça/cor": "raca_cor",
    "sexo": "genero",
    "salário": "salario",
    "tipomovimentação": "tipo_movimentacao",
}
OPTIONAL_COLUMNS = {
    BALANCE: BALANCE,
    DISABILITY: DISABILITY,
}

# canonical source column -> accepted normalised spellings, best first
HEADER_SPELLINGS = {
    "competênciamov": ["competenciamov", "competenciamovimento", "competencia"],
    "município": ["municipio", "codmunicipio", "cod_municipio"],
    "cnae20subclasse": ["cnae20subclasse", "subclasse"],
    "cbo2002ocupação": ["cbo2002ocupacao", "cbo"],
    "graudeinstrução": ["graudeinstrucao", "grau_de_instrucao"],
    "idade": ["idade"],
    "raça/cor": ["racacor", "raca_cor", "raca"],
    "sexo": ["sexo"],
    "salário": ["salario", "salariomensal", "valorsalario", "valor_salario", "salariofixo"],
    "tipomovimentação": ["tipomovimentacao", "tipo_movimentacao"],
    BALANCE: ["saldomovimentacao"],
    DISABILITY: ["tipodedeficiencia", "tipo_deficiencia", "tipodeficiencia", "deficiencia", "pcd"],
}

# a file is taken for movement data when at least this many markers are in its header
HEADER_MARKERS = [
    "competenciamov",
    "municipio",
    "subclasse",
    "cbo2002ocupacao",
    "graudeinstrucao",
    "racacor",
    "tipomovimentacao",
]
MIN_HEADER_MARKERS = 5

# spellings of the disability column in clean files, best first
CLEAN_DISABILITY_SPELLINGS = [DISABILITY, "tipodedeficiencia", "tipo_deficiencia", "deficiencia"]

# text cells that common tabular readers take for a missing value
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

ADMISSION_CODES = [10, 20, 25]
ADMISSION_STEM = "admi"

# --- fixed values: quality limits ------------------------------------------

MIN_AGE, MAX_AGE = 14, 80
MIN_SALARY, MAX_SALARY = 0.0, 200_000.0
MIN_QUALITY_WEIGHT = 0.6
MIN_HISTORY_MONTHS = 24
OUTLIER_MEAN, OUTLIER_FACTOR = 5_000.0, 1.5
FORECAST_MONTHS, FORECAST_ALPHA = 60, 0.05
FALLBACK_BOUNDS = ("2020-01", "2023-12")

NULL_KEY = "nan"
UNKNOWN_CODE = "9"

# --- fixed values: municipality prefix -> (state, region) --------------------

STATES = {
    "11": ("RO", "NORTE"), "12": ("AC", "NORTE"), "13": ("AM", "NORTE"),
    "14": ("RR", "NORTE"), "15": ("PA", "NORTE"), "16": ("AP", "NORTE"),
    "17": ("TO", "NORTE"),
    "21": ("MA", "NORDESTE"), "22": ("PI", "NORDESTE"), "23": ("CE", "NORDESTE"),
    "24": ("RN", "NORDESTE"), "25": ("PB", "NORDESTE"), "26": ("PE", "NORDESTE"),
    "27": ("AL", "NORDESTE"), "28": ("SE", "NORDESTE"), "29": ("BA", "NORDESTE"),
    "31": ("MG", "SUDESTE"), "32": ("ES", "SUDESTE"), "33": ("RJ", "SUDESTE"),
    "35": ("SP", "SUDESTE"),
    "41": ("PR", "SUL"), "42": ("SC", "SUL"), "43": ("RS", "SUL"),
    "50": ("MS", "CENTRO-OESTE"), "51": ("MT", "CENTRO-OESTE"),
    "52": ("GO", "CENTRO-OESTE"), "53": ("DF", "CENTRO-OESTE"),
}

# --- fixed values: code -> label, per vocabulary ------------------------------
# model: names in stored projections; history: dashboard tables;
# chart: chart series; factor: bars of the regression charts

LABELS = {
    "genero": {
        "model": {"1": "MASC", "3": "FEM"},
        "history": {"1": "Homem", "3": "Mulher"},
        "chart": {"1": "Homens", "3": "Mulheres"},
        "factor": {"MASC": "Homens", "FEM": "Mulheres"},
    },
    "raca_cor": {
        "model": {"1": "BRANCA", "2": "PRETA", "3": "PARDA", "4": "AMARELA", "5": "INDIGENA"},
        "history": {
            "1": "Branca", "2": "Preta", "3": "Parda", "4": "Amarela", "5": "Indígena",
            "6": "Não informada", "9": "Não Identificado",
        },
        "chart": {"1": "Branca", "2": "Preta", "3": "Parda", "4": "Amarela", "5": "Indígena"},
        "factor": {
            "1": "Branca", "2": "Preta", "3": "Parda", "4": "Amarela", "5": "Indígena",
            "6": "Não informada", "9": "Não Identificado",
        },
    },
    "grau_instrucao": {
        "model": {
            "1": "ANALFABETO", "2": "FUND INCOMPL", "3": "FUND COMPL", "4": "MED INCOMPL",
            "5": "MED COMPL", "6": "SUP INCOMPL", "7": "SUP COMPL", "8": "POS-GRAD",
            "9": "MESTRADO", "10": "DOUTORADO", "11": "POS-DOC",
        },
        "chart": {
            "1": "Analfabeto", "2": "Fundamental incompleto", "3": "Fundamental completo",
            "4": "Médio incompleto", "5": "Médio completo", "6": "Superior incompleto",
            "7": "Superior completo", "8": "Pós-graduação", "9": "Mestrado",
            "10": "Doutorado", "11": "Pós-doutorado",
        },
        "factor": {
            "1": "Analfabeto", "2": "Fund. Incompl.", "3": "Fund. Compl.",
            "4": "Médio Incompl.", "5": "Médio Compl.", "6": "Sup. Incompl.",
            "7": "Sup. Compl.", "8": "Pós-grad.", "9": "Mestrado", "10": "Doutorado",
            "11": "Pós-doc.",
        },
    },
    DISABILITY: {
        "model": {
            "0": "NAO DEFICIENTE", "1": "FISICA", "2": "AUDITIVA", "3": "VISUAL",
            "4": "INTELECTUAL", "5": "MULTIPLA", "6": "REABILITADO", "9": "NAO IDENTIFICADO",
        },
        "chart": {
            "0": "Não Deficiente", "1": "Física", "2": "Auditiva", "3": "Visual",
            "4": "Intelectual (Mental)", "5": "Múltipla", "6": "Reabilitado",
            "9": "Não Identificado",
        },
        "factor": {
            "0": "Não deficiente", "1": "Física", "2": "Auditiva", "3": "Visual",
            "4": "Intelectual", "5": "Múltipla", "6": "Reabilitado", "9": "Não Identificado",
        },
    },
}

VALID_RACES = ["1", "2", "3", "4", "5", "6", "9"]
UNIDENTIFIED_EDUCATION = ["80", "99"]

# dimension of the cube -> column of the regression design
REGRESSION_COLUMNS = {
    "genero": "genero_nome",
    "raca_cor": "raca_cor",
    "grau_instrucao": "grau_instrucao",
    DISABILITY: "tipo_def",
}
REGRESSION_CATEGORIES = [
    "genero_nome", "raca_cor", "cnae_divisao", "grau_instrucao", "tipo_def", "regiao",
]

# --- fixed values: colours of the chart series --------------------------------

RACE_COLOURS = {
    "1": "#4e79a7", "2": "#e15759", "3": "#f28e2b", "4": "#edc948", "5": "#b07aa1",
}
EDUCATION_PALETTE = [
    "#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f",
    "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac",
]
DISABILITY_PALETTE = [
    "#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#9c755f",
]
