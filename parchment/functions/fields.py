"""The fields of a land record: their labels by group of languages, and what a value looks like. All of this is fixed
values; patterns are made from it."""

from __future__ import annotations

import re
import unicodedata

# Languages that share patterns.
GROUPS = {"main": ("hi", "mr", "en", "gu", "pa"), "bn": ("bn", "as"), "ta": ("ta",), "te": ("te",), "kn": ("kn",), "ml": ("ml",), "ur": ("ur",)}
GROUP_SCRIPT = {"bn": "Bengali", "ta": "Tamil", "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "ur": "Arabic"}
MIXED_SCRIPTS = ("Devanagari", "Bengali", "Tamil", "Telugu", "Kannada", "Malayalam", "Gujarati", "Gurmukhi", "Oriya")

# Labels of each field, in their order.
LABELS = {
    "survey_number": {
        "main": "सर्वे|सर्वेक्षण|survey|survey no|survey number|SR|SR\\.?|SRNO", "bn": "দাগ|দাগ নম্বর|dag|dag no", "ta": "தொடர்பு|தொடர்பு எண்|survey",
        "te": "సರ್ವే|సర్వే Números|survey", "kn": "ಸರ್ವೇ|ಸರ್ವೇ ನಂಬರ್|survey", "ml": "സർവേ|സർവേ നമ്പർ|survey", "ur": "سروی|سروی نمبر|survey",
    },
    "khata_number": {
        "main": "खाता|खतौनी|खतियान|khata|khatian|khatoni", "bn": "খতিয়ান|খাতা|khatian", "ta": "பட்டா|பட்டா எண்|patta", "te": "పట్టు|పట్టు నంబరు|patta",
        "kn": "ಪಟ್ಟೆ|ಪಟ್ಟೆ ನಂಬರ್|patta", "ml": "പട്ടയം|പട്ടയം നമ്പർ|patta", "ur": "खतौनी|खतियान|khata",
    },
    "khasra_number": {"main": "खसरा|खसरा नंबर|khasra|khasra no|khasra number", "bn": "খসড়া|খসড়া নম্বর|khasra"},
    "owner_name": {
        "main": "मालिक|स्वामी|धारक|owner|name of owner|owner name", "bn": "মালিক|ধারক|owner", "ta": "உரிமையாளர்|owner", "te": "స్వామి|owner",
        "kn": "ಮಾಲೀಕ|owner", "ml": " ഉടമ|owner", "ur": "مالک|owner",
    },
    "father_name": {
        "main": "पिता|पुत्र|पुत्री|पत्नी|father|husband|s/o|d/o|w/o", "bn": "পিতা|পুত্র|father|husband", "ta": "தந்தை|கணவர்|father|husband",
        "te": "తండ్రి|భర్త|father|husband", "kn": "ತಂದೆ|ಗಂಡ|father|husband", "ml": "അച്ഛൻ|ഭർത്താവ്|father|husband", "ur": "والد|شوہر|father|husband",
    },
    "village": {
        "main": "ग्राम|मौजा|गांव|village|vill", "bn": "গ্রাম|মৌজা|village", "ta": "கிராமம்|village", "te": "గ్రామం|village", "kn": "ಗ್ರಾಮ|village",
        "ml": "গ্রামം|village", "ur": "گاؤں|موعزہ|village",
    },
    "tehsil": {
        "main": "तहसील|तालुका|तालुक|tehsil|taluk|taluka", "bn": "উপজেলা|তালুকা|tehsil", "ta": "தாலுகா|tehsil", "te": "మండలం|tehsil", "kn": "ತಾಲೂಕು|tehsil",
        "ml": "താലൂക്ക്|tehsil", "ur": "تحصیل|tehsil",
    },
    "district": {
        "main": "जिला|जिल्हा|district|dist", "bn": "জেলা|district", "ta": "மாவட்டம்|district", "te": "జిల్లా|district", "kn": "ಜಿಲ್ಲೆ|district",
        "ml": "ജില്ല|district", "ur": "ضلع|district",
    },
    "state": {
        "main": "राज्य|राज्|state", "bn": "রাজ্য|state", "ta": "மாநிலம்|state", "te": "రాష్ట్రం|state", "kn": "ರಾಜ್ಯ|state", "ml": "രാജ്യം|state", "ur": "ریاست|state",
    },
    "area": {
        "main": "रकबा|क्षेत्रफल|एरिया|area|land area|extent", "bn": "রকবা|এরিয়া|area", "ta": "விரிவ்|அலவு|area", "te": "వ్యాసం|ఎక్స్టెంట్|area",
        "kn": "ವಿಸ್ತೀರ್ಣ|area", "ml": "വിസ്തീർണ്ണം|area", "ur": "רקב|क्षेत्रफल|area",
    },
    "land_type": {
        "main": "भूमि प्रकार|जमीन प्रकार|लैंड टाइप|land type|classification|category|प्रकार", "bn": "জমির ধরন|land type", "ta": "நில வகை|land type",
        "te": "భూమి రకం|land type", "kn": "ಭೂಮಿ ವಿಧ|land type", "ml": "നില തരം|land type", "ur": "اراضی کی قسم|land type",
    },
    "mutation_number": {
        "main": "नामांतरण|दाखिल खारिज|म्यूटेशन|mutation|mutation no|mutation number", "bn": "নামজারি|দাখিল খারিজ|mutation", "ta": "நாமமாற்று|மিউடேஷன்|mutation",
        "te": "నామ మార్పు|మ్యుటేషన్|mutation", "kn": "ನಾಮ ಬದಲಾವಣೆ|ಮ್ಯುಟೇಶನ್|mutation", "ml": "നാമ മാറ്റം|മുടേഷൻ|mutation", "ur": "انتقال|میوٹیشن|mutation",
    },
    "registration_date": {
        "main": "पंजीकरण|रजिस्ट्री|बैनामा|निबंधन|registration|registration date|reg date|date of registration", "bn": "নিবন্ধন|রেজিস্ট্রেশন|registration",
        "ta": "பதிவு|ரஜிஸ்ட்ரேஷன்|registration", "te": "నివంధన|రెజిస్ట్రేషన్|registration", "kn": "ನೊಂದಣಿ|ರೆಜಿಸ್ಟ್ರೇಷನ್|registration",
        "ml": "നിബന്ധനം|റജിസ്ട്രേഷൻ|registration", "ur": "رجسٹری|رجسٹریشن|registration",
    },
    "stamp_duty": {
        "main": "स्टाम्प शुल्क|स्टाम्प ड्यूटी|स्टाम्प|stamp duty|stamp fee", "bn": "স্ট্যাম্প ডিউটি|স্ট্যাম্প শুল্ক|stamp duty", "ta": "ஸ்டாம்ப் ட்யூட்டி|ஸ்டாம்ப் கட்டணம்|stamp duty",
        "te": "స్టాంప్ డ్యూటీ|స్టాంప్ ప్రమాణం|stamp duty",
    },
    "seller": {
        "main": "विक्रेता|बेचने वाला|seller|vendor|transferor", "bn": "বিক্রেতা|seller", "ta": "விற்பனையாளர்|seller", "te": "విక్రేత|seller", "kn": "ವಿಕ್ರೇತರ|seller",
        "ml": "വിക്രേതാവ്|seller", "ur": "فروخت کنندہ|seller",
    },
    "buyer": {
        "main": "क्रेता|खरीदार|खरीदने वाला|buyer|purchaser|transferee", "bn": "ক্রেতা|buyer", "ta": "வாங்குபவர்|buyer", "te": "క్రేత|buyer", "kn": "ಕ್ರೇತರ|buyer",
        "ml": "വാങ്ങുന്നവർ|buyer", "ur": "خریدار|buyer",
    },
}

# Groups whose label stands in a capturing group by a slip, with what stands before it.
SLIPS = {
    ("state", "te"): "$:", ("mutation_number", "ur"): "::", ("registration_date", "te"): "::", ("stamp_duty", "te"): "::", ("seller", "te"): "::", ("buyer", "te"): "::",
}

# Units of area and of money by group.
AREA_UNITS = {
    "main": r"हेक्टेयर|hectare|ha|एकड़|acre|sq\.?\s*(?:मीटर|meter|m|ft|फीट|गज|yard|यार्ड)|वर्ग\s*(?:मीटर|meter|फीट|feet)|गुंठा|guntha|कट्ठा|katha|बिघा|bigha|बिस्वा|biswa",
    "bn": r"হেক্টেয়ার|hectare|একর|acre|বর্গ\s*(?:মিটার|meter|ফুট|feet)|কট্টা|katha|বিঘা|bigha|বিশ্বা|biswa",
    "ta": r"ஹெக்டேர்|hectare|ஏக்கர்|acre|சதுர\s*(?:மீட்டர்|meter|அடி|feet)|குண்டா|gunta|கேநி|cent",
    "te": r"హెక్టేర్|hectare|ఏకర|acre|చతుర\s*(?:మీటర్|meter|అడుగులు|feet)|గుంట|gunta|సెంట్|cent",
    "kn": r"ಹೆಕ್ಟೇರ್|hectare|ಏಕರ್|acre|ಚತುರ\s*(?:ಮೀಟರ್|meter|ಅಡಿ|feet)|ಗುಂಟಾ|gunta|ಸೆಂಟ್|cent",
    "ml": r"হেক্টেয়ার|hectare|ഏക്കർ|acre|ചതുര\s*(?:മീറ്റർ|meter|അടി|feet)|സെന്റ്|cent",
    "ur": r"हेक्टेयर|hectare|एकड़|acre",
}
MONEY_UNITS = {"main": "रु|रुपये|रूपए|₹|Rs|INR", "bn": "টাকা|৳|Rs|INR", "ta": "ரூ|ரூபாய்|Rs|INR", "te": "రూ|రూపాయి|Rs|INR"}

# How sure a match of a field makes, beyond the base.
BOOST = {
    "survey_number": 0.1, "khata_number": 0.1, "khasra_number": 0.05, "owner_name": 0.15, "father_name": 0.1, "village": 0.1, "tehsil": 0.1, "district": 0.1,
    "state": 0.1, "area": 0.2, "land_type": 0.15, "mutation_number": 0.1, "registration_date": 0.1, "stamp_duty": 0.05,
}

# What a value has to match from its start, and its lengths.
VALID = {
    "survey_number": ("^[A-Z0-9/\\-]+$", 3, 20), "khata_number": ("^[0-9]{3,6}$", 0, None), "khasra_number": ("^[A-Z0-9/\\-]+$", 0, None), "owner_name": (None, 3, 100),
    "father_name": (None, 3, 100), "village": (None, 2, 50), "tehsil": (None, 2, 50), "district": (None, 2, 50), "state": (None, 2, 50),
    "area": ("^[0-9]+(?:\\.[0-9]+)?", 0, None), "mutation_number": ("^[A-Z0-9/\\-]+$", 0, None),
    "registration_date": ("^[0-9]{1,2}[/\\-][0-9]{1,2}[/\\-][0-9]{2,4}$", 0, None), "stamp_duty": ("^[0-9,]+(?:\\.[0-9]+)?", 0, None), "seller": (None, 3, 100), "buyer": (None, 3, 100),
}
FINISH = {"owner_name": "name", "father_name": "name", "seller": "name", "buyer": "name", "area": "area", "registration_date": "date", "stamp_duty": "currency"}

CODES = ("survey_number", "khasra_number", "mutation_number")
PEOPLE = ("owner_name", "father_name", "seller", "buyer")
PLACES = ("village", "tehsil", "district", "state")

#: Words between a label and its value that intended patterns pass over.
BETWEEN = "no\\.?|number|नंबर|संख्या|नम्बर|date|दिनांक|तारीख"


def value_pattern(field: str, group: str) -> str:
    if field in CODES:
        return "[0-9/\\-]+" if (field, group) == ("survey_number", "bn") else "[A-Z0-9/\\-]+"
    if field == "khata_number":
        return "[0-9]+"
    if field == "area":
        return f"[0-9]+(?:\\.[0-9]+)?\\s*(?:{AREA_UNITS[group]})"
    if field == "registration_date":
        return "[0-9]{1,2}[/\\-][0-9]{1,2}[/\\-][0-9]{2,4}"
    if field == "stamp_duty":
        return f"[0-9,]+(?:\\.[0-9]+)?\\s*(?:{MONEY_UNITS[group]})"
    if field in ("owner_name", "father_name") and group == "main":
        return "[A-Za-z\\s.]+(?:[A-Za-z]+\\s){0,3}"
    dot = "" if field == "land_type" else "."
    if group == "main":
        return f"[A-Za-z{''.join(f'\\p{{Is{s}}}' for s in MIXED_SCRIPTS)}\\s{dot}]+"
    return f"[\\p{{Is{GROUP_SCRIPT[group]}}}\\s{dot}]+"


def has_script_class(field: str, group: str) -> bool:
    """Whether the pattern names a script, which the reference's regex engine rejects."""
    return "\\p{" in value_pattern(field, group)


def labels_by_length(field: str, group: str) -> str:
    return "|".join(sorted(LABELS[field][group].split("|"), key=len, reverse=True))


def pattern(field: str, group: str, compat: str | None) -> str:
    """The Java pattern of a field whose group 1 is the value.

    Intended patterns try long labels first, need a label to start a word and pass over words like "number". With
    compat="reference" labels stand in their order, and after a slip the label itself is group 1.
    """
    if compat == "reference":
        slip = SLIPS.get((field, group))
        head = f"({slip}{LABELS[field][group]})" if slip else f"(?:{LABELS[field][group]})"
        return f"(?iu){head}[\\s:]*({value_pattern(field, group)})"
    return f"(?iu)(?<![\\p{{L}}\\p{{M}}])(?:{labels_by_length(field, group)})(?:\\s*(?:{BETWEEN}))?[\\s:]*({value_pattern(field, group)})"


#: What `heads_pattern` is replaced by sets HEAD before a label, and behind it BAR, after as many more of them as tell the label's field.
HEAD, BAR = "\x01", "\x02"
ODD = 1
FIELD_BARS = {field: i for i, field in enumerate(LABELS, ODD + 1)}
HEADS = HEAD + "".join(f"{BAR}${i}" for i in (ODD, *FIELD_BARS.values())) + BAR


def starts_with(words: list[str]) -> str:
    """Java pattern that holds before the first letters of words, in any case; spares to try each word in most places."""
    alike = {"i": "\u0130\u0131", "k": "\u212a", "s": "\u017f"}
    return f"(?=[{''.join(sorted({x for w in words for x in (w[0], w[0].lower(), w[0].upper(), *alike.get(w[0].lower(), ''))}))}])"


def heads_pattern(group: str) -> str:
    """Java pattern of what stands before the values of all fields: label, words between, blanks and colons, as `pattern` has them.

    Its groups are labels by field. The first group has labels that another field's label starts in ("s/owner name"), which one match can't tell.
    """
    every = [(f, w) for f in LABELS if group in LABELS[f] for w in LABELS[f][group].split("|")]
    starts = [(f, w, i) for f, w in every for i in range(1, len(w)) if unicodedata.category(w[i - 1])[0] not in "LM"]
    odd = {w[:i] + max(v, w[i:], key=len) for f, w, i in starts for h, v in every if f != h and (v.startswith(w[i:]) or w[i:].startswith(v))}
    labels = [sorted(odd, key=len, reverse=True), *(labels_by_length(f, group).split("|") if group in LABELS[f] else [] for f in FIELD_BARS)]
    some = "|".join(f"{starts_with(x)}((?iu){'|'.join(x)})" if x else "(?!)()" for x in labels)
    begun = [(b, v[len(b) :]) for b in BETWEEN.split("|") for _, v in every if v.startswith(b)]  # a label that starts with a word between isn't one
    between = "|".join(b + "".join(f"(?!{rest})" for word, rest in begun if word == b) for b in BETWEEN.split("|"))
    blank = "|".join(w for _, w in every if w[0] == " ")
    gap = f"(?:(?!(?<![\\p{{L}}\\p{{M}}])(?:{blank}))[\\s:])*+" if blank else "[\\s:]*+"
    return f"(?<![\\p{{L}}\\p{{M}}]){starts_with([w for _, w in every])}(?:{some})(?iu)(?:\\s*(?:{between}))?+{gap}"


def characters(field: str, group: str) -> str:
    """The class of a value that is a run of characters, without its brackets. What may follow the class in an owner's name is in it."""
    return re.match(r"\[(.*?)\]\+", value_pattern(field, group))[1]
