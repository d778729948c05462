"""Rule tables and word lists, as parameters' defaults.

Fixed values: the words, patterns and durations below must be these for right results.
"""

from __future__ import annotations

WEEKDAYS = ["ראשון", "שני", "שלישי", "רביעי", "חמישי", "שישי", "שבת"]
ENGLISH_WEEKDAYS = ["Sunday", "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday"]
DAY_PREFIX = "יום"

PLACEHOLDERS = ["טרם נקבע", "יעודכן", "יתעדכן"]
EMPTY_MARKS = ["—", "-"]
EVENING = "בערב"
CANCELLED = "בוטל"
STATUSES = ["active", "cancelled", "tbd"]

MIXED, WOMEN, FAMILIES = "גם לגברים", "נשים", "משפחות"

#: label, first and last start; the windows overlap.
DAYPARTS = [("morning", "06:00", "12:00"), ("noon", "12:00", "17:00"), ("evening", "17:00", "23:59"), ("night", "21:00", "23:59")]

SOURCE_TABLE = "02_מרכז_ספורט_אלונים_טבלה.docx"
SOURCE_DIRTY = "03_מרכז_כושר_נופים_מלוכלך.docx"
#: source, day, start, name, minutes (None: known to be unknown), priority (lowest wins); a None key matches all.
DURATIONS = [
    (SOURCE_TABLE, None, None, "אקווה אירובי", 45, 1),
    (SOURCE_TABLE, None, None, "ריקודי עם", 70, 1),
    (SOURCE_TABLE, None, None, None, 55, 2),
    (SOURCE_DIRTY, "ראשון", "08:00", "התעמלות מתונהה", None, 1),
    (SOURCE_DIRTY, "ראשון", "09:00", "פילטיס", 50, 1),
    (SOURCE_DIRTY, "שני", "07:40", "התעמלות מתונה", None, 1),
    (SOURCE_DIRTY, "שני", "19:10", "זומבה", 50, 1),
    (SOURCE_DIRTY, "שני", "20:10", "יוגה", 50, 1),
    (SOURCE_DIRTY, "שלישי", "08:30", "ספינינג", 50, 1),
    (SOURCE_DIRTY, "רביעי", "09:15", "התעמלות במים", 45, 1),
    (SOURCE_DIRTY, "רביעי", "18:30", "קיקבוקס", 60, 1),
    (SOURCE_DIRTY, "חמישי", "09:00", "פלדנקרייז", 60, 1),
    (SOURCE_DIRTY, "חמישי", "19:00", "פילאטיס", 60, 1),
    (SOURCE_DIRTY, "שישי", "08:30", "עיצוב דינמי", 50, 1),
]

AUDIENCE_BY_NAME = {
    "dirty": ["יוגה", "ספינינג", "קיקבוקס", "פלדנקרייז", "פילאטיס"],
    "bilingual": ["פילאטיס", "יוגה זורמת", "ספינינג", "אימון פונקציונלי", "יוגה"],
}
AUDIENCE_ALIASES = {"Women only": WOMEN, "Women Only": WOMEN, "women only": WOMEN, "Mixed": MIXED, "mixed": MIXED}
AUDIENCES = ["נשים", "גם לגברים", "גברים", "ילדים", "נוער", "משפחות"]
NAME_FIXES = {"התעמלות מתונהה": "התעמלות מתונה", "פילטיס": "פילאטיס"}

SECTION_START = ["לוח שיעורי סטודיו", "לוח חוגים"]
GROUPED_START, EDGE_START = ["החוגים שלנו"], ["לוח שיעורי סטודיו"]
EDGE_END, GROUPED_END_PREFIX = "הודעות והערות חשובות", "ט.ל.ח"
SECTION_LABELS = ["שיעורי בוקר:", "שיעורי ערב:"]
INSTRUCTOR_KEY, PLACE_KEY, AUDIENCE_KEY, DAYS_KEY, HOUR_KEY, ROOM_KEY = "מדריך/ה:", "מיקום:", "קהל:", "ימים:", "שעה:", "אולם:"
LEVEL_PREFIX = "רמת "
BRANCHES = ["א", "ב"]
BRANCH_WORD = "סניף"
SEASONS = [("summer", ["עונת הקיץ", "בקיץ"]), ("winter", ["עונת החורף", "בחורף"])]
NOTE_FLAGS = [("בליווי הורה", "requires_parent"), ("לא יתקיים בחודש אוגוסט", "not_active_in_august"), ("חובה הרשמה מראש", "registration_required")]
TABLE_HEADER = ["שעה", "ראשון", "שני"]
BILINGUAL_HEADER = ["day", "time", "class", "instructor"]
BILINGUAL_COLUMNS = {"Day": "raw_day", "Time": "raw_time", "Class / חוג": "raw_name", "Instructor": "raw_instructor", "Room": "raw_room"}
SPORT = "ספורט"

TODAY, TOMORROW, YESTERDAY = "היום", "מחר", "אתמול"
ACTIVITY_WORDS = ["חוג", "חוגים", "שיעור", "שיעורים", "פעילות", "פעילויות"]
VAGUE_OPENERS = ["אני רוצה משהו", "אני מחפש משהו", "אני מחפשת משהו", "בא לי משהו", "רוצה משהו", "מחפש משהו", "מחפשת משהו"]
GENERIC_OPENERS = ["מה יש", "מה קורה", "יש משהו", "יש משו", "מה אפשר"]
CLUES = [
    "היום", "מחר", "אתמול", "ראשון", "שני", "שלישי", "שלשי", "רביעי", "רבעי", "חמישי", "שישי", "שבת", "בוקר", "בקר", "צהריים", "צהרים", "ערב", "ארב", "לילה",
    "מרכז", "מרקז", "סניף", "מדריך", "מיקום", "פילאטיס", "יוגה", "ספורט",
]
AT_HOUR, AT_PREFIX, AFTER, BEFORE = "בשעה", "ב-", "אחרי", "לפני"
#: daypart, words that count anywhere, words that count alone.
DAYPART_WORDS = [("morning", ["בבוקר"], ["בוקר"]), ("noon", ["בצהריים"], ["צהריים", "צהרים"]), ("evening", ["בערב"], ["ערב", "ארב"]), ("night", ["בלילה"], ["לילה"])]
AUDIENCE_WORDS = [(MIXED, ["גברים", "לגבר"]), (WOMEN, ["לנשים", "נשים בלבד"]), (FAMILIES, ["משפחה", "משפחות"])]
NO_CENTERS = ["ערב", "ארב", "בוקר", "בקר", "צהריים", "צהרים", "לילה", "היום", "מחר", "אתמול"]
CENTER_PREFIXES = ["מרכז הספורט", "מרכז ספורט", "מרכז הכושר", "מרכז"]
DAY_VARIANTS = {"שלישי": ["שלישי", "שלשי"], "רביעי": ["רביעי", "רבעי"]}

EDGE_PUNCTUATION = "?!.,:;׳״\"'…"
GREETINGS = ["שלום", "היי", "הי", "הלו", "אהלן", "בוקר טוב", "צהריים טובים", "ערב טוב", "לילה טוב", "מה נשמע", "מה קורה"]
THANKS = ["תודה", "תודה רבה", "המון תודה", "תודה לך", "תודה רבה לך", "מעולה תודה", "אחלה תודה", "סבבה תודה"]
STOP_SIGNALS = ["מספיק", "לא צריך", "זה מספיק", "סיימתי", "עזוב", "עזבי"]
THANKS_SIGNALS = ["תודה", "תודע", "תודהה"]
MORE_ANSWERS = [
    "כן", "כן בבקשה", "כן בבקש", "בטח", "בטח שכן", "יאללה", "יאללה עוד", "בסדר", "אוקיי", "אוקי", "אפשר", "אפשר עוד", "אפשר בבקשה", "אפשר להמשיך", "אפשר המשיך",
    "עוד", "תמשיך", "תמשיכי",
]
MORE, NO, ENOUGH, NO_NEED = "עוד", "לא", "מספיק", "לא צריך"
CLEAR_PHRASES = [
    ("center_name", ["בלי מרכז", "לא משנה המרכז", "לא משנה איזה מרכז", "עזוב את המרכז", "עזבי את המרכז", "כל מרכז"]),
    ("day", ["בלי יום", "לא משנה היום", "כל יום", "בלי יום מסוים"]),
    ("time", ["בכל שעה", "בלי שעה", "לא משנה השעה", "כל שעה", "לא משנה הזמן"]),
    ("instructor", ["בלי מדריך", "לא משנה המדריך", "כל מדריך"]),
    ("age", ["בלי גיל", "לא משנה הגיל", "כל גיל"]),
    ("category", ["בלי סוג", "לא משנה הסוג", "כל חוג", "כל פעילות"]),
]
FOLLOW_UP_SIGNALS = [
    "ומה", "ואיזה", "ואילו", "וביום", "ובערב", "ובבוקר", "ובלילה", "ואיפה", "ומה עם", "ומה לגבי", "יש גם", "גם ביום", "גם בערב", "בלי", "לא משנה", "עזוב את",
    "עזבי את", "בכל שעה", "כל שעה", "כל יום",
]
COMPLETE_QUERY_SIGNALS = ["חוג", "חוגים", "שיעור", "שיעורים", "מה יש", "אילו", "איזה", "יש משהו", "יש משו"]
QUERY_FRAME = ("אילו חוגים יש ", "?")
SEARCH_FIELDS = ["category", "age", "target_audience", "day", "start_after", "start_before", "location", "center_name", "branch", "instructor"]

#: The words of a display line.
DISPLAY = {
    "center": "מרכז: ", "branch": "סניף ", "instructor": "מדריך/ה: ", "location": "מיקום: ", "age": "גיל ", "from_age": "מגיל ", "to_age": "עד גיל ",
    "no_age": "לא צוין טווח גיל במקור", "audience": "קהל: ", "status": "סטטוס: ", "notes": "הערות: ",
}
