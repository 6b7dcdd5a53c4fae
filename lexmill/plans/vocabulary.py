"""The words, patterns and limits of the profiles.

They decide results, so they stand here as text, once, in the order in which they are tried. Patterns are
written for Java's regular expressions; functions.rx.PREFIX goes before each.
"""

# Profile codes with their languages and other names, in lookup order.
PROFILES = {
    "generic": (None, ["default", "global", "generic"]),
    "ru": ("ru", ["ru", "ru-ru", "russia", "россия"]),
    "us": ("en", ["us", "usa", "united states", "u.s."]),
    "eu": ("en", ["eu", "european union"]),
    "ae": ("en", ["ae", "uae", "u.a.e.", "united arab emirates"]),
}

# Families of legal documents by profile: id, kind, names.
DOC_FAMILIES = {
    "generic": [],
    "ru": [
        ("konstitucia_rf", "constitutional_norm", ["КРФ", "Конституция РФ", "Конституция Российской Федерации"]),
        ("gk_rf", "code", ["ГК РФ", "Гражданский кодекс РФ"]),
        ("apk_rf", "code", ["АПК РФ", "Арбитражный процессуальный кодекс РФ"]),
        ("gpk_rf", "code", ["ГПК РФ", "Гражданский процессуальный кодекс РФ"]),
        ("kas_rf", "code", ["КАС РФ", "Кодекс административного судопроизводства РФ"]),
        ("upk_rf", "code", ["УПК РФ", "Уголовно-процессуальный кодекс РФ"]),
        ("uk_rf", "code", ["УК РФ", "Уголовный кодекс РФ"]),
        ("koap_rf", "code", ["КоАП РФ", "Кодекс РФ об административных правонарушениях"]),
        ("nk_rf", "code", ["НК РФ", "Налоговый кодекс РФ"]),
        ("tk_rf", "code", ["ТК РФ", "Трудовой кодекс РФ"]),
        ("sk_rf", "code", ["СК РФ", "Семейный кодекс РФ"]),
        ("vs_plenum", "court_guidance", ["Пленум ВС РФ", "Постановление Пленума Верховного Суда РФ"]),
        ("fed_law", "primary_legislation", ["Федеральный закон №", "Федеральный закон N", "Федеральный закон от", "ФЗ №", "ФЗ N"]),
    ],
    "us": [
        ("usc", "code", ["U.S.C.", "USC", "United States Code"]),
        ("cfr", "secondary_legislation", ["CFR", "Code of Federal Regulations"]),
        ("frcp", "procedure_rules", ["FRCP", "Federal Rules of Civil Procedure"]),
        ("bankruptcy_code", "code", ["Bankruptcy Code", "U.S. Bankruptcy Code"]),
        ("scotus", "case_law", ["SCOTUS", "Supreme Court of the United States"]),
        ("delaware_gcl", "primary_legislation", ["DGCL", "Delaware General Corporation Law"]),
    ],
    "eu": [
        ("gdpr", "regulation", ["GDPR", "General Data Protection Regulation"]),
        ("eu_regulation", "regulation", ["Regulation (EU)", "EU Regulation"]),
        ("eu_directive", "directive", ["Directive (EU)", "EU Directive"]),
        ("cjeu", "case_law", ["CJEU", "Court of Justice of the European Union"]),
    ],
    "ae": [
        ("adgm_regulations", "regulatory_instrument", ["ADGM", "Abu Dhabi Global Market"]),
        ("difc_law", "primary_legislation", ["DIFC", "Dubai International Financial Centre", "DIFC Law", "DIFC Laws"]),
        ("dfsa", "regulatory_instrument", ["DFSA", "Dubai Financial Services Authority"]),
        ("vara", "regulatory_instrument", ["VARA", "Virtual Assets Regulatory Authority"]),
        ("cbuae", "regulatory_instrument", ["CBUAE", "Central Bank of the UAE", "UAE Central Bank"]),
        ("uae_federal_law", "primary_legislation", ["UAE Federal Law", "Federal Law No.", "Federal Decree-Law"]),
    ],
}

# Chunk policy by kind of document; profiles add and remove entries.
POLICIES = {"code": "statute", "primary_legislation": "statute", "secondary_legislation": "statute", "court_guidance": "guidance", "guidance": "guidance", "case_law": "case_law", "commentary": "guidance", "other": "default"}
POLICY_CHANGES = {"us": {"court_guidance": None, "procedure_rules": "statute"}}
MAX_CHARS, OVERLAP_CHARS = 1200, 120

# What else a profile switches on.
SWITCHES = {
    "us": {"trim_rules_body": True, "trim_running_headers": True, "merge_wrapped": True, "article_splitter": "us_rule", "long_rule_titles": True},
    "eu": {"drop_lines": ["EN"], "drop_patterns": [r"^[CL]\s+\d+/\d+$", r"^\(\d+\)\s+OJ\s+[CL]\s+\d+"], "merge_wrapped": True, "root_splitter": "eu_recitals", "article_splitter": "eu_article", "block_signatures": True},
    "ae": {"root_splitter": "title_preamble", "oversized_splitter": "rulebook"},
}

# Numbering words by profile and family.
_COMMON = {
    "article_like": ["article", "articles", "art.", "art"],
    "chapter_like": ["chapter", "chapters"],
    "section_like": ["section", "sections", "sec.", "sec", "subsection", "subsections"],
    "point_like": ["clause", "clauses", "item", "items"],
    "subpoint_like": ["subclause", "subclauses", "subsection", "subsections"],
    "paragraph_like": ["paragraph", "paragraphs", "para.", "para", "subparagraph", "subparagraphs"],
    "part_like": ["part", "parts", "title", "titles"],
    "annex_like": ["annex", "annexes", "appendix", "appendices", "schedule", "schedules", "exhibit", "exhibits"],
}
NUMBERING = {
    "generic": _COMMON,
    "ae": _COMMON,
    "us": _COMMON | {"section_like": ["section", "sections", "sec.", "sec", "§", "§§"]},
    "eu": _COMMON | {
        "point_like": ["point", "points"],
        "subpoint_like": ["subpoint", "subpoints", "subparagraph", "subparagraphs"],
        "paragraph_like": ["paragraph", "paragraphs", "para.", "para", "alinéa", "alinea"],
        "annex_like": ["annex", "annexes", "appendix", "appendices", "schedule", "schedules"],
    },
    "ru": {
        "article_like": "статья статьи статье статью статьей статьёй статей статьям статьями статьях ст. article art.".split(),
        "chapter_like": "глава главы главе главу главой главою глав главам главами главах гл. chapter".split(),
        "section_like": "раздел раздела разделу разделе разделом разделы разделов разделам разделами разделах разд. разд подраздел подраздела подразделу подразделе подразделом подразделы подразделов подразделам подразделами подразделах подразд. section".split(),
        "point_like": "пункт пункта пункту пункте пунктом пункты пунктов пунктам пунктами пунктах п. clause".split(),
        "subpoint_like": "подпункт подпункта подпункту подпункте подпунктом подпункты подпунктов подпунктам подпунктами подпунктах подп. подп пп.".split(),
        "paragraph_like": "абзац абзаца абзацу абзаце абзацем абзацы абзацев абзацам абзацами абзацах абз. paragraph §".split(),
        "part_like": "часть части частью частей частям частями частях ч. part".split(),
        "annex_like": "приложение приложения приложению приложении приложением приложений приложениям приложениями приложениях прил. annex appendix".split(),
    },
}

# Heading keywords by profile, in the order in which headings are tried.
_ROMAN, _ORDINALS = r"[ivxlcdm\d]+", "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
_LIST = r"\d+(?:\.\d+)*(?:\s*[–-]\s*\d+(?:\.\d+)*)?(?:\s*,\s*\d+(?:\.\d+)*)*"
_CHAPTER, _SECTION = r"chapter|chap\.?|chapitre|kapitel", r"section|sec\.?|sect\.?|division|abschnitt"
_ARTICLE, _CLAUSE, _PARAGRAPH = r"article|art\.?|artikel", r"clause|cl\.?", r"paragraph|para\.?|§|absatz|alinéa|alinea"
_SCHEDULE, _MIXED = "schedule|annex|appendix|exhibit|аннекс", r"[a-zа-яivxlcdm\d]+"
_DASH = r"(?:[–-]\s*)?"
HEADINGS: dict[str, list[tuple[str, str, str, str]]] = {  # type, keywords, number, what may stand before the title
    "generic": [
        ("part", "part|title|titre", f"(?:{_ROMAN}|{_ORDINALS})", ""), ("chapter", _CHAPTER, _ROMAN, ""), ("section", _SECTION, _ROMAN, ""),
        ("article", _ARTICLE, _LIST, ""), ("clause", _CLAUSE, _LIST, ""), ("paragraph", _PARAGRAPH, _LIST, ""), ("schedule", _SCHEDULE, _MIXED, ""),
        ("roman", "", "", ""), ("numeric", "A-Za-z", "", ""),
    ],
    "ru": [
        ("part", "часть|part|title|titre", f"(?:{_ROMAN}|первая|вторая|третья|четвертая|четвёртая|пятая|шестая|седьмая|восьмая|девятая|десятая)", ""),
        ("chapter", "глава|" + _CHAPTER, _ROMAN, ""), ("section", "раздел|" + _SECTION, _ROMAN, ""), ("article", r"статья|ст\.?|" + _ARTICLE, _LIST, ""),
        ("clause", r"пункт|пункты|п\.?|" + _CLAUSE, _LIST, ""), ("paragraph", "параграф|" + _PARAGRAPH, _LIST, ""),
        ("schedule", r"schedule|annex|appendix|exhibit|приложение|прил\.?|аннекс", _MIXED, ""), ("roman", "", "", ""), ("numeric", "A-Za-zА-Яа-яЁё", "", ""),
    ],
    "us": [
        ("part", "part|title", _ROMAN, ""), ("chapter", _CHAPTER, _ROMAN, ""), ("section", r"section|sec\.?|sect\.?|§|division", _ROMAN, ""),
        ("rule", "rule", r"\d+(?:\.\d+)*", ""), ("article", _ARTICLE, _LIST, ""), ("paragraph", _PARAGRAPH, _LIST, ""), ("schedule", _SCHEDULE, _MIXED, ""),
        ("roman", "", "", ""), ("numeric", "A-Za-z", "", ""),
    ],
    "eu": [
        ("part", "part|title|titre", f"(?:{_ROMAN}|premier|deuxième|troisième|quatrième|cinquième)", ""), ("chapter", r"chapter|chapitre|chap\.?|kapitel", _ROMAN, ""),
        ("section", _SECTION, _ROMAN, ""), ("article", _ARTICLE, _LIST, ""), ("paragraph", r"paragraph|para\.?|alinéa|alinea|§|absatz", _LIST, ""),
        ("schedule", "schedule|annex|appendix|аннекс", _MIXED, ""), ("roman", "", "", ""), ("numeric", "A-Za-z", "", ""),
    ],
    "ae": [
        ("part", "part|title", f"(?:{_ROMAN}|{_ORDINALS})", _DASH), ("chapter", r"chapter|chap\.?", _ROMAN, _DASH), ("section", r"section|sec\.?", _ROMAN, _DASH),
        ("article", r"article|art\.?", _LIST, ""), ("paragraph", r"paragraph|para\.?|§", _LIST, ""), ("schedule", "schedule|annex|appendix|exhibit", r"[a-zivxlcdm\d]+", _DASH),
        ("roman", "", "", ""), ("alpha", "", "", ""), ("numeric", "A-Za-z", "", ""),
    ],
}
WEAK_FIRST_WORDS = "a an the this that these those it its they their he she we you".split()

# Patterns of citations beyond numbering words: scheme, pattern with the number as group 1, family.
TOKEN = r"(?:[A-Za-z]\.?\s*)?\d+[A-Za-z0-9()./-]*"
CITATIONS = {
    "us": [("section", r"\b\d+\s+U\.?\s*S\.?\s*C\.?\s*§+\s*(" + TOKEN + ")", "usc"), ("section", r"\b\d+\s+C\.?\s*F\.?\s*R\.?\s*§+\s*(" + TOKEN + ")", "cfr")],
    "eu": [("recital", r"\bRecital\s+(" + TOKEN + ")", None), ("recital", r"\bRecital\s*\((" + TOKEN + r")\)", None)],
}

# How court decisions are cited in Russian reviews.
CASE_STRIP = r"(?s)\b\d{1,2}\s+См\.\s+также\b.*$"
CASE_PREFIXED = r"((?:Определение|Постановление)\s+[^.\n]{0,160}?(?:от\s+[0-9]{1,2}\s+[А-Яа-я]+(?:\s+[0-9]{4})?\s*г?\.?)?\s*№\s*[A-Za-zА-Яа-я0-9\-/]+\.?)"
CASE_TAIL = r"(от\s+[0-9]{1,2}\s+[А-Яа-я]+(?:\s+[0-9]{4})?\s*г?\.?\s*№\s*[A-Za-zА-Яа-я0-9\-/]+)"
CASE_NUMBER = r"№\s*([A-Za-zА-Яа-я0-9\-/]+)"
CASE_DATE = r"от\s+([0-9]{1,2}\s+[А-Яа-я]+(?:\s+[0-9]{4})?\s*г?\.?)"
COURTS = [("Верховный Суд РФ", ["Судебной коллегии Верховного Суда РФ", "Судебная коллегия Верховного Суда РФ", "Верховного Суда РФ", "Верховный Суд РФ"])]
