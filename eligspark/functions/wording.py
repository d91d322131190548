"""Wording of reasons in the template languages, and the Column functions that fill it in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eligspark.functions.text import let

# fmt: off
# Every text below, by language; braces hold what is filled in.
FIELDS = {
    "en": {
        "age": "age",
        "income": "income",
        "land": "land",
        "education_class": "class",
        "education_stage": "course of study",
        "gender": "gender",
        "category": "category",
        "residence": "rural or urban residence",
        "marital_status": "marital status",
        "state": "state",
        "bpl_household": "BPL status",
        "registered_construction_worker": "welfare board registration",
        "occupation": "occupation",
        "not_availing_other_scheme": "other benefits already received",
        "other": "the scheme's other conditions",
    },
    "hi": {
        "age": "आयु",
        "income": "आय",
        "land": "ज़मीन",
        "education_class": "कक्षा",
        "education_stage": "पढ़ाई का स्तर",
        "gender": "लिंग",
        "category": "वर्ग",
        "residence": "ग्रामीण या शहरी निवास",
        "marital_status": "वैवाहिक स्थिति",
        "state": "राज्य",
        "bpl_household": "बीपीएल स्थिति",
        "registered_construction_worker": "कल्याण बोर्ड में पंजीकरण",
        "occupation": "व्यवसाय",
        "not_availing_other_scheme": "पहले से मिल रहे लाभ",
        "other": "योजना की बाकी शर्तों",
    },
    "te": {
        "age": "వయస్సు",
        "income": "ఆదాయం",
        "land": "భూమి",
        "education_class": "తరగతి",
        "education_stage": "చదువు స్థాయి",
        "gender": "లింగం",
        "category": "వర్గం",
        "residence": "గ్రామీణ లేదా పట్టణ నివాసం",
        "marital_status": "వైవాహిక స్థితి",
        "state": "రాష్ట్రం",
        "bpl_household": "BPL స్థితి",
        "registered_construction_worker": "సంక్షేమ బోర్డులో నమోదు",
        "occupation": "వృత్తి",
        "not_availing_other_scheme": "ఇప్పటికే పొందుతున్న ప్రయోజనాలు",
        "other": "పథకం ఇతర షరతులు",
    },
}
AND = {"en": " and ", "hi": " और ", "te": " మరియు "}
OR = {"en": " or ", "hi": " या ", "te": " లేదా "}
STOP = {"en": ".", "hi": "।", "te": "."}
TEMPLATE = {
    "en": {
        "eligible": "Every condition we could check is met: {passed}.",
        "partly": "Needs checking: {passed} checked out, but {pending} must still be confirmed.",
        "nothing": "Needs checking: nothing about you could be checked automatically, so {pending} must be confirmed.",
        "clause": " The scheme's first condition: “{clause}”",
    },
    "hi": {
        "eligible": "जिन शर्तों की जाँच हो सकी, वे सब पूरी होती हैं: {passed}।",
        "partly": "जाँच ज़रूरी: मेल खाती शर्तें — {passed}; लेकिन {pending} की पुष्टि अभी बाकी है।",
        "nothing": "जाँच ज़रूरी: आपकी कोई जानकारी अपने-आप नहीं जाँची जा सकी, इसलिए {pending} की पुष्टि ज़रूरी है।",
        "clause": " योजना की पहली शर्त: “{clause}”",
    },
    "te": {
        "eligible": "తనిఖీ చేయగలిగిన అన్ని షరతులు నెరవేరాయి: {passed}.",
        "partly": "తనిఖీ అవసరం: సరిపోయిన షరతులు — {passed}; కానీ {pending} ఇంకా నిర్ధారించాలి.",
        "nothing": "తనిఖీ అవసరం: మీ గురించి ఏదీ స్వయంచాలకంగా తనిఖీ చేయలేకపోయాము, కాబట్టి {pending} నిర్ధారించాలి.",
        "clause": " పథకం మొదటి షరతు: “{clause}”",
    },
}
RULE = {
    "en": {
        "age_range": "This scheme's age limit is {lo}-{hi}",
        "age_exact": "This scheme is for people aged {lo}",
        "age_min": "This scheme's minimum age is {lo}",
        "age_max": "This scheme's maximum age is {hi}",
        "income": "This scheme's limit on {basis}income is ₹{cap} a year",
        "land_range": "This scheme is for {lo}-{hi} acres of land",
        "land_min": "This scheme needs at least {lo} acres of land",
        "land_max": "This scheme is for up to {hi} acres of land",
        "class_range": "This scheme is for students in class {lo}-{hi}",
        "class_min": "This scheme is for students in class {lo} or above",
        "class_max": "This scheme is for students up to class {hi}",
        "gender": "This scheme is only for {g}",
        "category": "This scheme is only for: {cats}",
        "residence": "This scheme is only for people living in {r} areas",
        "marital_status": "This scheme is only for these marital statuses: {ms}",
        "state": "This scheme is only for residents of {state}",
        "bpl_household": "This scheme is only for BPL (below poverty line) households",
        "registered_construction_worker": "This scheme is only for workers registered with the construction workers' welfare board",
    },
    "hi": {
        "age_range": "इस योजना की आयु सीमा {lo}-{hi} वर्ष है",
        "age_exact": "यह योजना {lo} वर्ष की आयु के लोगों के लिए है",
        "age_min": "इस योजना के लिए न्यूनतम आयु {lo} वर्ष है",
        "age_max": "इस योजना के लिए अधिकतम आयु {hi} वर्ष है",
        "income": "इस योजना में {basis}वार्षिक आय की सीमा ₹{cap} है",
        "land_range": "यह योजना {lo}-{hi} एकड़ ज़मीन वालों के लिए है",
        "land_min": "इस योजना के लिए कम से कम {lo} एकड़ ज़मीन चाहिए",
        "land_max": "यह योजना {hi} एकड़ तक ज़मीन वालों के लिए है",
        "class_range": "यह योजना कक्षा {lo}-{hi} के विद्यार्थियों के लिए है",
        "class_min": "यह योजना कक्षा {lo} या उससे ऊपर के विद्यार्थियों के लिए है",
        "class_max": "यह योजना कक्षा {hi} तक के विद्यार्थियों के लिए है",
        "gender": "यह योजना केवल {g} के लिए है",
        "category": "यह योजना केवल इन वर्गों के लिए है: {cats}",
        "residence": "यह योजना केवल {r} क्षेत्रों में रहने वालों के लिए है",
        "marital_status": "यह योजना केवल इन वैवाहिक स्थितियों के लिए है: {ms}",
        "state": "यह योजना केवल {state} के निवासियों के लिए है",
        "bpl_household": "यह योजना केवल बीपीएल (गरीबी रेखा से नीचे) परिवारों के लिए है",
        "registered_construction_worker": "यह योजना केवल निर्माण श्रमिक कल्याण बोर्ड में पंजीकृत श्रमिकों के लिए है",
    },
    "te": {
        "age_range": "ఈ పథకం వయో పరిమితి {lo}-{hi} సంవత్సరాలు",
        "age_exact": "ఈ పథకం {lo} సంవత్సరాల వయస్సు ఉన్నవారికి",
        "age_min": "ఈ పథకానికి కనీస వయస్సు {lo} సంవత్సరాలు",
        "age_max": "ఈ పథకానికి గరిష్ఠ వయస్సు {hi} సంవత్సరాలు",
        "income": "ఈ పథకంలో వార్షిక {basis}ఆదాయ పరిమితి ₹{cap}",
        "land_range": "ఈ పథకం {lo}-{hi} ఎకరాల భూమి ఉన్నవారికి",
        "land_min": "ఈ పథకానికి కనీసం {lo} ఎకరాల భూమి ఉండాలి",
        "land_max": "ఈ పథకం {hi} ఎకరాల వరకు భూమి ఉన్నవారికి",
        "class_range": "ఈ పథకం {lo}-{hi} తరగతుల విద్యార్థులకు",
        "class_min": "ఈ పథకం {lo}వ తరగతి లేదా అంతకంటే పై విద్యార్థులకు",
        "class_max": "ఈ పథకం {hi}వ తరగతి వరకు విద్యార్థులకు",
        "gender": "ఈ పథకం {g} మాత్రమే",
        "category": "ఈ పథకం ఈ వర్గాలకు మాత్రమే: {cats}",
        "residence": "ఈ పథకం {r} ప్రాంతాల్లో నివసించే వారికి మాత్రమే",
        "marital_status": "ఈ పథకం ఈ వైవాహిక స్థితులకు మాత్రమే: {ms}",
        "state": "ఈ పథకం {state} నివాసులకు మాత్రమే",
        "bpl_household": "ఈ పథకం BPL (దారిద్ర్య రేఖకు దిగువన ఉన్న) కుటుంబాలకు మాత్రమే",
        "registered_construction_worker": "ఈ పథకం భవన నిర్మాణ కార్మికుల సంక్షేమ బోర్డులో నమోదైన కార్మికులకు మాత్రమే",
    },
}
SAID = {
    "en": {
        "age": "you said {v}",
        "income": "you said ₹{v}",
        "land": "you said {v} acres",
        "education_class": "you said class {v}",
        "gender": "you said you are {g}",
        "residence": "you said you live in a {r} area",
        "marital_status": "you said you are {ms}",
        "state": "you said you live in {v}",
        "bpl_household": "you said you are not BPL",
        "registered_construction_worker": "you said you are not registered",
        "caste": "you said your category is {v}",
        "minority": "you said you are not from a religious minority",
        "disability": "you said your disability is {v}%",
    },
    "hi": {
        "age": "आपने अपनी आयु {v} वर्ष बताई है",
        "income": "आपने ₹{v} बताया है",
        "land": "आपने {v} एकड़ बताया है",
        "education_class": "आपने कक्षा {v} बताई है",
        "gender": "आपने बताया कि आप {g} हैं",
        "residence": "आपने बताया कि आप {r} क्षेत्र में रहते हैं",
        "marital_status": "आपने अपनी वैवाहिक स्थिति '{ms}' बताई है",
        "state": "आपने बताया कि आप {v} में रहते हैं",
        "bpl_household": "आपने बताया कि आप बीपीएल नहीं हैं",
        "registered_construction_worker": "आपने बताया कि आप पंजीकृत नहीं हैं",
        "caste": "आपने अपना वर्ग {v} बताया है",
        "minority": "आपने बताया कि आप अल्पसंख्यक समुदाय से नहीं हैं",
        "disability": "आपने अपनी विकलांगता {v}% बताई है",
    },
    "te": {
        "age": "మీరు మీ వయస్సు {v} సంవత్సరాలు అని చెప్పారు",
        "income": "మీరు ₹{v} అని చెప్పారు",
        "land": "మీరు {v} ఎకరాలు అని చెప్పారు",
        "education_class": "మీరు {v}వ తరగతి అని చెప్పారు",
        "gender": "మీరు {g} అని చెప్పారు",
        "residence": "మీరు {r} ప్రాంతంలో నివసిస్తున్నారని చెప్పారు",
        "marital_status": "మీరు మీ వైవాహిక స్థితి '{ms}' అని చెప్పారు",
        "state": "మీరు {v}లో నివసిస్తున్నారని చెప్పారు",
        "bpl_household": "మీరు BPL కాదని చెప్పారు",
        "registered_construction_worker": "మీరు నమోదు కాలేదని చెప్పారు",
        "caste": "మీరు మీ వర్గం {v} అని చెప్పారు",
        "minority": "మీరు మైనారిటీ వర్గానికి చెందరని చెప్పారు",
        "disability": "మీరు మీ వైకల్యం {v}% అని చెప్పారు",
    },
}
GENDERS = {
    "en": {"female": "women", "male": "men", "transgender": "transgender persons"},
    "hi": {"female": "महिलाओं", "male": "पुरुषों", "transgender": "ट्रांसजेंडर व्यक्तियों"},
    "te": {"female": "మహిళలకు", "male": "పురుషులకు", "transgender": "ట్రాన్స్‌జెండర్ వ్యక్తులకు"},
}
GENDER = {
    "en": {"female": "a woman", "male": "a man", "transgender": "transgender"},
    "hi": {"female": "महिला", "male": "पुरुष", "transgender": "ट्रांसजेंडर"},
    "te": {"female": "మహిళ", "male": "పురుషుడు", "transgender": "ట్రాన్స్‌జెండర్"},
}
RESIDENCE = {"en": {"rural": "rural", "urban": "urban"}, "hi": {"rural": "ग्रामीण", "urban": "शहरी"}, "te": {"rural": "గ్రామీణ", "urban": "పట్టణ"}}
MARITAL = {
    "en": {"married": "married", "unmarried": "unmarried", "widowed": "widowed", "divorced": "divorced", "separated": "separated", "abandoned": "abandoned"},
    "hi": {
        "married": "विवाहित",
        "unmarried": "अविवाहित",
        "widowed": "विधवा/विधुर",
        "divorced": "तलाकशुदा",
        "separated": "अलग रह रहे",
        "abandoned": "परित्यक्त",
    },
    "te": {
        "married": "వివాహిత",
        "unmarried": "అవివాహిత",
        "widowed": "వితంతు",
        "divorced": "విడాకులు పొందిన",
        "separated": "విడిగా ఉంటున్న",
        "abandoned": "వదిలివేయబడిన",
    },
}
CATEGORY = {
    "en": {"General": "General", "Minority": "religious minorities", "PwD": "persons with a disability of 40% or more"},
    "hi": {"General": "सामान्य वर्ग", "Minority": "अल्पसंख्यक", "PwD": "40% या अधिक विकलांगता वाले व्यक्ति"},
    "te": {"General": "జనరల్ వర్గం", "Minority": "మైనారిటీలు", "PwD": "40% లేదా అంతకంటే ఎక్కువ వైకల్యం ఉన్నవారు"},
}
FAMILY = {"en": "family ", "hi": "पारिवारिक ", "te": "కుటుంబ "}
NOUN = {"en": ("condition", "conditions"), "hi": ("शर्त", "शर्तों"), "te": ("షరతు", "షరతులు")}
COUNT = {
    "en": "{n} {noun} of this scheme still to confirm.",
    "hi": "इस योजना की {n} {noun} की पुष्टि अभी बाकी है।",
    "te": "ఈ పథకంలో {n} {noun} ఇంకా నిర్ధారించాలి.",
}
COUNT_OTHER = {
    "en": "{n} other {noun} of this scheme still to confirm.",
    "hi": "इस योजना की {n} और {noun} की पुष्टि अभी बाकी है।",
    "te": "ఈ పథకంలో మరో {n} {noun} ఇంకా నిర్ధారించాలి.",
}
SAID_VALUE = {
    "en": {
        "age": "You said your age is {v}",
        "annual_income_inr": "You said your income is ₹{v} a year",
        "land_acres": "You said you have {v} acres of land",
        "disability_percent": "You said your disability is {v}%",
    },
    "hi": {
        "age": "आपने अपनी आयु {v} वर्ष बताई है",
        "annual_income_inr": "आपने अपनी वार्षिक आय ₹{v} बताई है",
        "land_acres": "आपने {v} एकड़ ज़मीन बताई है",
        "disability_percent": "आपने अपनी विकलांगता {v}% बताई है",
    },
    "te": {
        "age": "మీరు మీ వయస్సు {v} సంవత్సరాలు అని చెప్పారు",
        "annual_income_inr": "మీరు మీ వార్షిక ఆదాయం ₹{v} అని చెప్పారు",
        "land_acres": "మీకు {v} ఎకరాల భూమి ఉందని చెప్పారు",
        "disability_percent": "మీరు మీ వైకల్యం {v}% అని చెప్పారు",
    },
}
OWN_TEXT = {
    "en": "{said}; this scheme's own text says: {quote}",
    "hi": "{said}; इस योजना के अपने पाठ में लिखा है: {quote}",
    "te": "{said}; ఈ పథకం సొంత పాఠం ఇలా చెబుతోంది: {quote}",
}
OWN_TEXT_UNQUOTED = {
    "en": "{said}; this scheme's own text sets its own {label} condition, which has to be confirmed.",
    "hi": "{said}; इस योजना के पाठ में {label} की अपनी शर्त है, जिसकी पुष्टि ज़रूरी है।",
    "te": "{said}; ఈ పథకం పాఠంలో {label}కు సొంత షరతు ఉంది, దాన్ని నిర్ధారించాలి.",
}
REQUIRES = {
    "en": "This scheme requires: {quote} That couldn't be checked from what you told us.",
    "hi": "यह योजना माँगती है: {quote} आपकी बताई जानकारी से इसकी जाँच नहीं हो सकी।",
    "te": "ఈ పథకానికి ఇది అవసరం: {quote} మీరు చెప్పిన వివరాలతో దీన్ని తనిఖీ చేయలేకపోయాము.",
}
REQUIRES_UNQUOTED = {
    "en": "This scheme has a {label} condition that couldn't be checked from what you told us.",
    "hi": "इस योजना में {label} की एक शर्त है, जिसकी जाँच आपकी बताई जानकारी से नहीं हो सकी।",
    "te": "ఈ పథకంలో {label}కు ఒక షరతు ఉంది, మీరు చెప్పిన వివరాలతో దాన్ని తనిఖీ చేయలేకపోయాము.",
}
CHECKED = {"en": "Checked: {passed}.", "hi": "जाँची गई शर्तें: {passed}।", "te": "తనిఖీ చేసినవి: {passed}."}
TRIGGER_LABEL = {
    "en": {"age": "age", "income": "income", "land": "land", "category": "disability"},
    "hi": {"age": "आयु", "income": "आय", "land": "ज़मीन", "category": "विकलांगता"},
    "te": {"age": "వయస్సు", "income": "ఆదాయం", "land": "భూమి", "category": "వైకల్యం"},
}
# fmt: on

LANGUAGES = ("en", "hi", "te")


def language(code: Column) -> Column:
    """The template language of a language code; others fall back to English."""
    return F.when(code.isin(*LANGUAGES), code).otherwise("en")


def worded(texts: dict[str, str], lang: Column, **values: Column) -> Column:
    """The text of the language with its braces filled in; a null value leaves its place empty."""
    out = F.lit(texts["en"])
    for code in LANGUAGES[1:]:
        out = F.when(lang == code, texts[code]).otherwise(out)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def of(tables: dict[str, dict[str, str]], key: str) -> dict[str, str]:
    """One text of each language."""
    return {code: tables[code][key] for code in LANGUAGES}


def named(tables: dict[str, dict[str, str]], key: Column, lang: Column) -> Column:
    """The word for a value in the language; the value itself if there is none."""
    words = F.create_map(*[F.lit(x) for code in LANGUAGES for word, text in tables[code].items() for x in (f"{code} {word}", text)])
    return F.coalesce(F.try_element_at(words, F.concat(lang, F.lit(" "), key)), key)


def joined(parts: Column, lang: Column, last: dict[str, str] = AND) -> Column:
    """X28: "a, b and c" in the language, without empty parts."""

    def put(kept: Column) -> Column:
        several = F.concat(F.array_join(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))), ", "), worded(last, lang), F.element_at(kept, -1))
        return F.when(F.size(kept) <= 1, F.array_join(kept, "")).otherwise(several)

    return let(F.filter(parts, lambda x: F.coalesce(x, F.lit("")) != ""), put)
