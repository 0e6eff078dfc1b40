"""Codes, cut points and word lists that decide results and are data, not logic."""

# Word written for a missing or empty text.
UNKNOWN_WORD = "bilinmiyor"

# Event types of the log.
EVENT_TYPES = ["VIEW", "ADD_CART", "REMOVE_CART", "BUY"]

# The two numberings of the event types in use.
EVENT_CODES = {
    "alphabetical": {"ADD_CART": 0, "BUY": 1, "REMOVE_CART": 2, "VIEW": 3},
    "funnel": {"ADD_CART": 0, "VIEW": 1, "REMOVE_CART": 2, "BUY": 3},
}

# Day parts: (first hour, last hour, label) with both ends inside, then the label of other hours.
DAY_PARTS = {
    "right_closed": ([(0, 6, "gece"), (7, 12, "sabah"), (13, 18, "oglen")], "aksam"),
    "left_closed": ([(0, 5, 3), (6, 11, 0), (12, 17, 1)], 2),
    "named": ([(6, 11, "morning"), (12, 17, "afternoon"), (18, 21, "evening")], "night"),
    "shifted": ([(5, 11, 0), (12, 16, 1), (17, 20, 2)], 3),
}

WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]

# Latin spellings of the lower-case letters of other alphabets.
FOLD_CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "i",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u",
    "ф": "f", "х": "kh", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "shch", "ъ": "", "ы": "y", "ь": "", "э": "e",
    "ю": "iu", "я": "ia", "ѐ": "ie", "ё": "io", "ђ": "dj", "ѓ": "gj", "є": "ie", "ѕ": "dz", "і": "i",
    "ї": "yi", "ј": "j", "љ": "lj", "њ": "nj", "ћ": "tsh", "ќ": "kj", "ѝ": "i", "ў": "u", "џ": "dzh",
}
FOLD_GREEK = {
    "α": "a", "β": "b", "γ": "g", "δ": "d", "ε": "e", "ζ": "z", "η": "e", "θ": "th", "ι": "i", "κ": "k",
    "λ": "l", "μ": "m", "ν": "n", "ξ": "x", "ο": "o", "π": "p", "ρ": "r", "ς": "s", "σ": "s", "τ": "t",
    "υ": "u", "φ": "ph", "χ": "kh", "ψ": "ps", "ω": "o",
}
# Letters that do not decompose into a base letter and a mark.
FOLD_SPECIAL = {
    "ß": "ss", "æ": "ae", "œ": "oe", "þ": "th", "ð": "d", "đ": "d", "ħ": "h", "ı": "i",
    "ĸ": "k", "ł": "l", "ŋ": "ng", "ø": "o", "ŧ": "t", "ſ": "s",
    "©": "c", "®": "r", "™": "tm", "°": "deg", "ª": "a", "º": "o", "µ": "u", " ": " ",
}

# Words that mark a state scholarship, as one alternation.
STATE_SCHOLARSHIP_PATTERN = (
    "kyk|kredi|yurt|ky|yk|kek|kvk|kre|kuk|kred|devlet|kredi yurtlar kurumu|kuru"
)

# Seeds of the bagged fits.
BAGGING_SEEDS = [
    42, 0, 12, 123, 1, 7, 999, 2020, 2021, 101, 1234, 11, 13, 27, 100, 2022, 256, 512, 777, 888, 321,
]

# Birth years kept.
BIRTH_YEARS = (1990, 2005)

# Grade ranges read as something else than the middle of the two numbers.
UNIVERSITY_GRADE_EXCEPTIONS = {
    "3.50 - 4.00": 3.25, "3.00-2.50": 3.00, "3.00 - 3.50": 3.00, "3.00 - 4.00": 3.00,
    "3.00 - 3.49": 3.00, "2.50 ve altı": 2.75, "2.50 - 2.99": 2.75, "1.80 - 2.49": 2.25,
    "0 - 1.79": 1.00,
}

# Scholarship amounts whose text does not add up to the amount meant.
AMOUNT_EXCEPTIONS = {
    "430tlyılda 10 ay": 430,
    "Toplamda 1000 lira fakat mezun oldugun icin devam etmiyor": 0,
    "10 ay süre ile aylık 600 TL": 600,
    "BİN TÜRK LİRASI": 1000,
    "kredi-300": 800,
    "8 Ay Boyunca Aylık 720 TL": 720,
    "350 TL - Türkiye Girişimcilik Vakfından burs kazandığım takdirde Çelik İhracatçıları "
    "Birliğindeki bursumdan vazgeçeceğim.": 0,
    "300TL nakit + yemek ve yurt bursu": 1000,
    "10 ay süresince 600 TL cep harçlığı": 600,
    "Aylık 490 TL - 9 ay boyunca": 490,
    "Nakit burslar 700TL, Nakde çevrilen yemek ve yol burslarıyla 1160": 1160,
    "Üstün başarı bursu - 750 TL": 1750,
    "780, 425": 1225,
    "380-425": 805,
    "Nakit Destek Bursu (9 Ay süre ile 660 TL)": 660,
    "Yıllık belirlenen kapsamlı burs kadar": 1000,
    "100% okul ve 50% yurt bursu": 2000,
    "9*100": 900,
    "2016-2017 yılı içinde aylık 400 Türk lirası": 400,
}

# Ordinal codes of the survey columns: column -> (lower-case first, codes, code of anything else).
YES_NO = {"Evet": 1, "Hayır": 0}
PARENT_EDUCATION = {
    "eğitim yok": 0, "eği̇ti̇m yok": 0, "eğitimi yok": 0, "0": 0,
    "ilkokul mezunu": 1, "i̇lkokul": 1,
    "ortaokul mezunu": 2, "ortaokul": 2,
    "lise": 3, "lise mezunu": 3, "li̇se": 3,
    "üniversite": 4, "üniversite mezunu": 4, "üni̇versi̇te": 4,
    "yüksek lisans": 5, "yüksek lisans / doktora": 5, "yüksek lisans / doktara": 5,
    "yüksek li̇sans": 5,
    "doktora": 6,
}
SIBLING_NOTES = {"Kardeş Sayısı 1 Ek Bilgi Aile Hk. Anne Vefat": 1}
SURVEY_CODES = {
    "Cinsiyet": (True, {"erkek": 1, "kadın": 2, "belirtmek istemiyorum": 0}, None),
    "Universite Kacinci Sinif": (
        True,
        {
            "-1": 0, "hazırlık": 0, "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6,
            "mezun": 7, "tez": 8, "yüksek lisans": 9,
        },
        None,
    ),
    "Stk Projesine Katildiniz Mi": (False, YES_NO, 0),
    "Ingilizce Seviyeniz": (False, {"Başlangıç": 1, "0": 2, "Orta": 3, "İleri": 4}, -1),
    "Ingilizce Biliyor musunuz": (False, YES_NO, -1),
    "Girisimcilik Kulupleri Tarzi Bir Kulube Uye misiniz": (False, YES_NO, -1),
    "Girisimcilikle Ilgili Deneyiminiz Var Mi": (False, YES_NO, -1),
    "Universite Turu": (True, {"özel": 1, "devlet": 0}, -1),
    "Lise Turu": (
        True,
        {
            "fen lisesi": 5, "anadolu lisesi": 4, "özel lisesi": 3, "özel lise": 3, "özel": 3,
            "düz lise": 2, "meslek lisesi": 2, "meslek": 2, "i̇mam hatip lisesi": 1,
            "devlet": 1, "diğer": 0,
        },
        0,
    ),
    "Baska Bir Kurumdan Burs Aliyor mu": (False, YES_NO, -1),
    "Aktif olarak bir STK yesi misiniz": (False, YES_NO, -1),
    "Profesyonel Bir Spor Daliyla Mesgul musunuz": (False, YES_NO, -1),
    "Burs Aliyor mu": (True, {"evet": 1, "hayır": 0}, -1),
    "Spor Dalindaki Rolunuz Nedir": (
        False,
        {
            "Diğer": 0, "0": 0, "Kaptan": 1, "KAPTAN / LİDER": 1, "DİĞER": 0,
            "Lider/Kaptan": 1, "Bireysel": 2, "Takım Oyuncusu": 3, "-": 0, "Bireysel Spor": 2,
        },
        None,
    ),
    "Baba Sektor": (
        True, {"0": 0, "özel sektör": 1, "kamu": 2, "diğer": 0, "di̇ğer": 0, "-": 0}, None,
    ),
    "Baba Calisma Durumu": (False, {"Emekli": 0, "Evet": 1, "Hayır": 0}, None),
    "Baba Egitim Durumu": (True, PARENT_EDUCATION, 0),
    "Anne Egitim Durumu": (True, PARENT_EDUCATION, 0),
    "Anne Calisma Durumu": (False, {"Hayır": 0, "Evet": 1, "Emekli": 0}, None),
    "Anne Sektor": (
        True, {"0": 0, "kamu": 1, "özel sektör": 2, "diğer": 0, "di̇ğer": 0, "-": 0}, None,
    ),
    "Daha Once Baska Bir Universiteden Mezun Olmus": (False, {"Hayır": 0, "Evet": 1}, None),
}
# Survey columns whose missing answer has a code of its own.
SURVEY_MISSING = {
    "Cinsiyet": 0, "Universite Kacinci Sinif": 0, "Spor Dalindaki Rolunuz Nedir": 0,
    "Baba Sektor": 0, "Baba Calisma Durumu": 0, "Anne Calisma Durumu": 0, "Anne Sektor": 0,
    "Daha Once Baska Bir Universiteden Mezun Olmus": 0,
}
