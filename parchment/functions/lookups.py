"""Lookup tables. Their values are fixed: results are compared by them."""

from __future__ import annotations

# Languages in order of preference, with the script each is written in.
LANGUAGE_SCRIPT = {
    "hi": "Devanagari", "mr": "Devanagari", "ne": "Devanagari", "bn": "Bengali", "as": "Bengali", "or": "Oriya", "ta": "Tamil",
    "te": "Telugu", "kn": "Kannada", "ml": "Malayalam", "gu": "Gujarati", "pa": "Gurmukhi", "ur": "Arabic", "en": "Latin",
}

# Code points of each script.
SCRIPT_RANGES = {
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Oriya": [(0x0B00, 0x0B7F)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Latin": [(0x0000, 0x024F)],
}

# Words that tell languages of one script apart.
LANGUAGE_KEYWORDS = {
    "hi": ["का", "की", "के", "में", "से", "को", "पर", "है", "हैं", "था", "थे"],
    "mr": ["चा", "ची", "चे", "मध्ये", "ते", "ला", "वर", "आहे", "होते"],
    "bn": ["ের", "এর", "দি", "তে", "কে", "এ", "আছে", "ছিল"],
    "ta": ["இன்", "அத்", "உள்ள", "என்", "ஆகும்", "இருந்தது"],
    "te": ["లో", "కి", "నీ", "మograp", "ఉన్నాయి"],
    "kn": ["ಅಲ್ಲಿ", "ಗೆ", "ನಿರ್ವಹಣ", "ಆಗಿದೆ"],
    "ml": ["ൽ", "ക്ക്", "ന്റെ", "ഉണ്ട്"],
    "gu": ["નાં", "ને", "માં", "છે"],
    "pa": ["ਦੇ", "ਨੂੰ", "ਵਿੱਚ", "ਹੈ"],
    "ur": ["کا", "کی", "کے", "میں", "سے", "کو", "پر", "ہے"],
    "en": ["the", "and", "of", "to", "in", "a", "is", "for", "on", "with"],
}

#: The first digit of each language that has digits of its own; the other nine follow it.
ZERO_DIGIT = {"hi": "०", "bn": "০", "ta": "௦", "te": "౦", "kn": "೦", "ml": "൦", "gu": "૦", "pa": "੦", "or": "୦"}

# Hindi vowel signs that a recogniser is held to confuse, each with the one put for it.
HINDI_SIGNS = {"ि": "ी", "ु": "ू", "े": "ै", "ो": "ौ"}

#: The sign that kills a vowel, in each script that has one.
VIRAMAS = "्্੍્୍்్್്"

# Words of land records by language.
VOCABULARY = {
    "hi": ["खसरा", "खतौनी", "मौजा", "तहसील", "जिला", "राज्य", "रकबा", "भूमि", "कृषि", "आवासीय", "वाणिज्यिक", "नामांतरण", "दाखिल", "खारिज",
           "पंजीकरण", "रजिस्ट्री", "बैनामा", "विक्रेता", "क्रेता", "गवाह", "स्टाम्प", "शुल्क", "हेक्टेयर", "एकड़", "वर्ग", "मीटर", "गज"],
    "bn": ["দাগ", "খতিয়ান", "মৌজা", "উপজেলা", "জেলা", "রকবা", "জমি", "কৃষি", "আবাসিক", "বাণিজ্যিক", "নামজারি", "দাখিল", "খারিজ", "নিবন্ধন",
           "বিক্রেতা", "ক্রেতা", "হেক্টের", "একর"],
    "ta": ["தொடர்பு", "பட்டா", "கிராமம்", "தாலுகா", "மாவட்டம்", "நிலம்", "விவசாய", "அபிவாசி", "வணிக", "நாமமாற்று", "பதிவு", "விற்பனையாளர்",
           "வாங்குபவர்", "ஹெக்டேர்", "ஏக்கர்"],
    "te": ["సర్వే", "పట్టు", "గ్రామం", "మండలం", "జిల్లా", "భూమి", "వ్యవసాయ", "ఆవాసిక", "వ్యాపారిక", "నామ మార్పు", "నివంధన", "విక్రేత", "క్రేత",
           "హెక్టేర్", "ఏకర"],
    "kn": ["ಸರ್ವೇ", "ಪಟ್ಟೆ", "ಗ್ರಾಮ", "ತಾಲೂಕು", "ಜಿಲ್ಲೆ", "ಭೂಮಿ", "ಕೃಷಿ", "ನಿವಾಸ", "ವಾಣಿಜ್ಯ", "ನಾಮ ಬದಲಾವಣೆ", "ನೊಂದಣಿ", "ವಿಕ್ರೇತರ", "ಕ್ರೇತರ",
           "ಹೆಕ್ಟೇರ್", "ಏಕರ್"],
    "ml": ["സർവേ", "പട്ടയം", "ഗ്രാമം", "താലൂക്ക്", "ജില്ല", "നിലം", "കൃഷി", "ആവാസിക", "വാണിജ്യ", "നാമ മാറ്റം", "നിബന്ധനം", "വിക്രേതാവ്",
           "വാങ്ങുന്നവർ", "ഹെക്ടെയർ", "ഏക്കർ"],
    "gu": ["સર્વે", "સાતબારા", "ગામ", "તાલુકા", "જિલ્લો", "જમીન", "કૃષિ", "આવાસિક", "વ્યાપારિક", "નામ ફેરફાર", "નોંધણી", "વિક્રેતા", "ખરીદાર",
           "હેક્ટર", "એકર"],
    "pa": ["ਸਰਵੇ", "ਜਮਾਬੰਦੀ", "ਗਾਂਵ", "ਤਹਿਸੀਲ", "ਜ਼ਿਲ੍ਹਾ", "ਜ਼ਮੀਨ", "ਖੇਤੀਬਾੜੀ", "ਆਵਾਸੀਕ", "ਵਿਆਪਾਰੀਕ", "ਨਾਮ ਬਦਲੀ", "ਰਜਿਸਟ੍ਰੀ", "ਵਿਕਰੇਤਾ",
           "ਖਰੀਦਦਾਰ", "ਹੈਕਟੇਅਰ", "ਏਕੜ"],
    "ur": ["سرvey", "ختنون", "موعزہ", "تحصیل", "ضلع", "اراضی", "زرعی", "رہائشی", "تجارتی", "انتقال", "رجسٹری", "فروخت کنندہ", "خریدار", "ہیکٹر", "ایکر"],
    "en": ["survey", "khata", "khasra", "village", "tehsil", "district", "state", "area", "hectare", "acre", "agricultural", "residential", "commercial",
           "mutation", "registration", "registry", "seller", "buyer", "witness", "stamp", "duty", "square", "meter"],
}

# Weights of the recognisers, and which come first and second for a language.
MODEL_WEIGHTS = {"paddle_ocr": 1.0, "trocr": 0.9, "easyocr": 0.8, "tesseract": 0.7}
UNKNOWN_WEIGHT = 0.5
MODEL_ORDER = {
    "hi": ("paddle_ocr", "trocr"), "bn": ("paddle_ocr", "trocr"), "ta": ("paddle_ocr", "easyocr"), "te": ("paddle_ocr", "easyocr"),
    "ur": ("tesseract", "paddle_ocr"), "en": ("trocr", "paddle_ocr"),
}

# Titles before names, and fields that a land record must have.
NAME_TITLES = ["श्री", "श्रीमती", "सुश्री", "डॉ", "डॉक्टर", "Mr", "Mrs", "Ms", "Dr", "Shri", "Smt"]
REQUIRED_FIELDS = ["survey_number", "owner_name", "village", "tehsil", "district", "state", "area"]

# Language groups.
LANGUAGE_GROUPS = {
    "north": ["hi", "mr", "pa", "ur", "en"],
    "south": ["ta", "te", "kn", "ml", "en"],
    "east": ["bn", "as", "or", "en"],
    "west": ["gu", "mr", "hi", "en"],
    "all_indic": ["hi", "bn", "ta", "te", "kn", "ml", "mr", "gu", "pa", "or", "as", "ur"],
}

# Words that name a type of land, by language.
LAND_TYPE_WORDS = {
    "hi": ["कृषि", "कृषि भूमि", "आवासीय", "आवासीय भूमि", "वाणिज्यिक", "व्यावसायिक", "बंजर", "वन", "चारागाह", "नदी", "तालाब"],
    "bn": ["কৃষি", "কৃষি জমি", "আবাসিক", "বাণিজ্যিক", "বন", "নদী", "পুকুর"],
    "ta": ["விவசாய", "விவசாய நிலம்", "அபிவாசி", "வணிக", "காடு", "நதி", "குளம்"],
    "te": ["వ్యవసాయ", "వ్యవసాయ భూమి", "ఆవాసిక", "వ్యాపారిక", "అడవి", "నది", "చేручుక técnологియా"],
    "kn": ["ಕೃಷಿ", "ಕೃಷಿ ಭೂಮಿ", "ನಿವಾಸ", "ವಾಣಿಜ್ಯ", "ಕಾಡು", "ನದಿ", "ಕೇರಾ"],
    "ml": ["കൃഷി", "കൃഷി ഭൂമി", "ആവാസിക", "വാണിജ്യ", "കാട്", "നദി", "കുളം"],
    "gu": ["કૃષિ", "કૃષિ જમીન", "આવાસિક", "વ્યાપારિક", "જંગલ", "નદી", "તળાવ"],
    "pa": ["ਕ੍ਰਿਸ਼ੀ", "ਕ੍ਰਿਸ਼ੀ ਜ਼ਮੀਨ", "ਆਵਾਸੀਕ", "ਵਿਆਪਾਰੀਕ", "ਜੰਗਲ", "ਨਦੀ", "ਤਲਾਬ"],
    "ur": ["زرعی", "زرعی اراضی", "رہائشی", "تجارتی", "جنگل", "دریا", "تعلب"],
    "en": ["agricultural", "agricultural land", "residential", "commercial", "forest", "river", "pond", "barren", "pasture"],
}
