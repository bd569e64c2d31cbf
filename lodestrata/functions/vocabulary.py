"""Word lists, extension tables and patterns that results depend on."""

# fixed values of role evaluation: a figure that may stand for a person, an attribute of something else, then what
# speaks against a match: nobody and nothing worn, a garment without its attribute, a costume for a dress; and its weight
STAND_IN_WORDS = ("character", "hero", "superhero", "illustration")
STAND_IN, ELSEWHERE = 0.4, 0.2
NOBODY, UNBOUND, COSTUME, AGAINST = 0.70, 0.65, 0.60, 0.75

FILE_LABELS = {
    ".pdf": "PDF Document", ".docx": "Word Document", ".txt": "Text Document", ".jpg": "JPG Image", ".jpeg": "JPEG Image", ".png": "PNG Image",
    ".gif": "GIF Image", ".webp": "WebP Image", ".bmp": "Bitmap Image", ".tiff": "TIFF Image", ".xlsx": "Excel Spreadsheet", ".xls": "Excel Spreadsheet",
    ".csv": "CSV File", ".pptx": "PowerPoint Presentation", ".ppt": "PowerPoint Presentation", ".zip": "ZIP Archive", ".rar": "RAR Archive",
    ".7z": "7Z Archive", ".mp3": "MP3 Audio", ".wav": "WAV Audio", ".flac": "FLAC Audio", ".py": "Python Script", ".js": "JavaScript File",
    ".ts": "TypeScript File", ".java": "Java Source", ".c": "C Source", ".cpp": "C++ Source", ".html": "HTML Document", ".css": "CSS Stylesheet",
    ".json": "JSON Data", ".md": "Markdown Document",
}
VIDEO = [".mp4", ".mkv", ".avi", ".mov", ".wmv", ".flv", ".webm", ".m4v"]
AUDIO = [".mp3", ".wav", ".flac", ".aac", ".m4a", ".ogg", ".wma"]
IMAGES = [".jpg", ".jpeg", ".png", ".webp", ".bmp", ".tiff", ".gif", ".svg", ".ico"]
#: One category per extension.
EXT_CATEGORY = {
    "Document": [".pdf", ".docx", ".txt", ".md", ".rtf"], "Image": [".jpg", ".jpeg", ".png", ".gif", ".webp", ".bmp", ".tiff"], "Video": VIDEO, "Audio": AUDIO,
    "Spreadsheet": [".xlsx", ".xls", ".csv", ".tsv"], "Presentation": [".pptx", ".ppt"],
    "Code": [".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".c", ".cpp", ".h", ".cs", ".go", ".rs", ".html", ".css", ".json", ".xml", ".yaml", ".yml", ".sql"],
    "Archive": [".zip", ".rar", ".7z", ".tar", ".gz"],
}
#: Filter categories; an extension may be in several.
FILTER_CATEGORY = {
    "Document": [".pdf", ".docx", ".doc", ".txt", ".md", ".rtf", ".pptx", ".ppt", ".xlsx", ".xls", ".csv", ".tsv", ".odt", ".ods", ".epub"],
    "Image": IMAGES, "Video": VIDEO, "Audio": AUDIO, "Spreadsheet": [".xlsx", ".xls", ".csv", ".tsv"], "Presentation": [".pptx", ".ppt"],
    "Code": [*EXT_CATEGORY["Code"], ".sh", ".bat"], "Archive": [".zip", ".rar", ".7z", ".tar", ".gz", ".bz2", ".xz"],
    "Media": [*VIDEO, ".mp3", ".wav", ".flac", ".aac", ".m4a"],
}
MOVIE_TAGS = "1080p|720p|2160p|4k|uhd|fhd|bluray|bdrip|brrip|web-dl|webrip|hdrip|dvdrip|x264|x265|hevc|yify|yts|rarbg"
MOVIE_BYTES = 350 * 1024 * 1024

SENSITIVE_PATTERNS = {
    "aadhaar": r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b",
    "pan": r"\b[A-Z]{5}[0-9]{4}[A-Z]\b",
    "ifsc": r"\b[A-Z]{4}0[A-Z0-9]{6}\b",
    "card": r"\b(?:4[0-9]{12}(?:[0-9]{3})?|5[1-5][0-9]{14}|3[47][0-9]{13}|6(?:011|5[0-9]{2})[0-9]{12})\b",
    "account": r"(?i)\b(?:a/c|acct|account(?:\s+no|\s+number)?)[\s.:#-]*([0-9]{9,18})\b",
    "passport": r"\b[A-Z][0-9]{7}\b",
    "voter": r"\b[A-Z]{3}[0-9]{7}\b",
}
BANKING_WORDS = ["bank", "statement", "passbook", "salary slip", "payslip", "neft", "rtgs", "imps", "cheque", "deposit", "withdrawal", "hdfc", "sbi", "icici", "axis", "kotak", "pnb", "canara", "union bank", "overdraft", "balance"]
ID_WORDS = ["aadhaar", "uidai", "income tax department", "pan card", "passport", "election commission", "voter", "epic", "driving licence", "driving license", "identity card", "id card", "govt of india"]
CONFIDENTIAL_WORDS = ["strictly confidential", "private and confidential", "confidential", "nda", "non-disclosure", "proprietary", "trade secret", "internal use only"]

#: Taxonomy words by category; short ones match whole words.
EDUCATION_WORDS = ["assignment", "syllabus", "lecture", "homework", "exam", "question paper", "da", "dsa", "dbms", "os", "cn"]
WORK_WORDS = ["resume", "cv", "project plan", "meeting notes", "contract", "offer letter", "agreement"]
TRAVEL_WORDS = ["ticket", "boarding pass", "flight", "hotel", "itinerary", "booking", "visa"]

AMBIENT = ["vibrant", "cinematic", "aesthetic", "cozy", "moody", "warm", "cool", "serene", "dramatic", "modern", "vintage", "clean", "minimalist", "beautiful", "nice", "stunning", "blurred", "clear", "bright", "dark", "soft lighting", "high contrast", "realistic", "high quality"]
SYNONYMS = {
    "qr-code": "qr code", "qrcode": "qr code", "bar-code": "barcode", "id-card": "id card", "idcard": "id card", "time-table": "timetable", "schedule": "timetable",
    "pup": "dog", "puppy": "dog", "hound": "dog", "canine": "dog", "kitten": "cat", "feline": "cat", "automobile": "car", "vehicle": "car",
    "laptop computer": "laptop", "notebook": "laptop", "flyer": "poster", "pamphlet": "poster", "infographic": "diagram", "flowchart": "diagram",
}
ACRONYMS = {
    "dbms": ["Database Management System", "Database Management Systems", "Database"],
    "dsa": ["Data Structures and Algorithms", "Data Structures & Algorithms", "Data Structures"],
    "os": ["Operating System", "Operating Systems"], "cn": ["Computer Networks", "Computer Network"], "ai": ["Artificial Intelligence"],
    "ml": ["Machine Learning"], "dl": ["Deep Learning"], "nlp": ["Natural Language Processing"],
    "oops": ["Object Oriented Programming", "Object-Oriented Programming"], "oop": ["Object Oriented Programming", "Object-Oriented Programming"],
    "se": ["Software Engineering"], "daa": ["Design and Analysis of Algorithms"], "toc": ["Theory of Computation"], "id": ["ID", "Identity", "Identification", "ID Card"],
}
COMPOUNDS = {"timetable": "time table", "time table": "timetable", "flowchart": "flow chart", "flow chart": "flowchart", "screenshot": "screen shot", "screen shot": "screenshot", "wireframe": "wire frame", "wire frame": "wireframe"}
STRUCTURAL_TYPES = ["poster", "flyer", "infographic", "timetable", "schedule", "id card", "identity card", "certificate", "receipt", "invoice", "bill", "ticket", "diagram", "chart", "flowchart", "wireframe", "screenshot", "presentation", "slide", "slides"]
VISUAL_TERMS = ["photo", "picture", "image", "pic", "selfie", "camera", "snapshot", "drawing", "illustration", "artwork", "graphic", "logo", "wallpaper", "portrait", "dress", "shirt", "wearing", "clothes", "clothing", "outfit", "tshirt"]
DOCUMENT_TYPES = {
    "Bank Statement": ("Banking & Finance", ["bank statement", "account statement", "bank stmt", "passbook", "bank passbook"]),
    "Invoice": ("Banking & Finance", ["invoice", "tax invoice", "bill", "receipt", "payment slip"]),
    "Salary Slip": ("Banking & Finance", ["salary slip", "pay slip", "payslip", "compensation slip"]),
    "Aadhaar": ("IDs & Documents", ["aadhaar", "aadhar", "uidai", "e-aadhaar", "eaadhaar"]),
    "PAN": ("IDs & Documents", ["pan card", "pan number", "permanent account number", "nsdl pan", "uti pan"]),
    "Passport": ("IDs & Documents", ["passport", "indian passport"]),
    "Driving Licence": ("IDs & Documents", ["driving licence", "driving license", "dl card", "dl copy", "driver license"]),
    "College ID": ("IDs & Documents", ["college id", "student id", "university id", "campus id", "id card", "identity card"]),
    "Certificate": ("Education", ["certificate", "degree", "diploma", "marksheet", "transcript", "award"]),
    "Resume": ("Work", ["resume", "cv", "curriculum vitae"]),
    "Assignment": ("Education", ["assignment", "digital assignment", "da", "lab assignment", "assessment", "homework"]),
    "Report": ("Work", ["report", "project report", "audit report", "summary report"]),
    "Presentation": ("Work", ["presentation", "powerpoint", "ppt", "pptx", "slides", "deck"]),
    "Timetable": ("Education", ["timetable", "time table", "class schedule", "exam schedule", "routine"]),
    "Ticket": ("Travel", ["ticket", "boarding pass", "flight ticket", "train ticket", "bus ticket", "itinerary"]),
}
CATEGORY_WORDS = {
    "Banking & Finance": ["bank", "statement", "finance", "account", "tax", "ifsc", "salary", "invoice", "bill", "cheque", "loan", "mutual fund"],
    "IDs & Documents": ["id", "identity", "aadhaar", "aadhar", "pan", "passport", "license", "licence", "voter id", "id card"],
    "Personal Photos": ["photo", "photos", "picture", "pictures", "pic", "pics", "selfie", "portrait", "snapshot", "camera"],
    "Education": ["college", "university", "syllabus", "assignment", "timetable", "notes", "lecture", "module", "exam", "grade", "study", "dbms", "dsa", "os", "cn"],
    "Work": ["work", "office", "resume", "cv", "project", "presentation", "report", "meeting", "client", "contract"],
    "Travel": ["travel", "ticket", "hotel", "flight", "trip", "vacation", "boarding pass", "itinerary", "booking"],
}
FILE_TYPE_WORDS = {
    "image": ["photo", "photos", "pic", "pics", "picture", "pictures", "image", "images", "selfie", "jpg", "jpeg", "png", "webp"],
    "pdf": ["pdf", "pdfs"],
    "document": ["document", "documents", "doc", "docs", "docx", "word", "text", "txt"],
    "spreadsheet": ["excel", "sheet", "sheets", "spreadsheet", "xlsx", "xls", "csv"],
    "presentation": ["ppt", "pptx", "powerpoint", "slides", "presentation"],
    "video": ["video", "videos", "movie", "movies", "clip", "mp4", "mkv"],
    "audio": ["audio", "song", "songs", "music", "mp3", "recording"],
    "code": ["code", "script", "program", "python", "java", "typescript", "javascript", "cpp", "c++", "html", "css", "sql"],
    "archive": ["zip", "rar", "7z", "archive", "tar"],
}
IGNORED_FOLDERS = [".git", ".svn", ".hg", ".venv", "venv", "env", "__pycache__", "node_modules", ".idea", ".vscode", "AppData", "$RECYCLE.BIN", "System Volume Information"]
IGNORED_EXTENSIONS = [".tmp", ".temp", ".crdownload", ".part", ".swp", ".lock", ".log", ".bak", "~"]
ROMANISED_WORDS = ["oda", "kaatu", "kaattu", "kooda", "potta", "irukku", "paaru", "vechu", "padam", "padangal", "eduthu", "enaku", "enakku", "nethu", "venum", "kudunga", "irukka", "illai", "enga", "enna", "iruntha", "pannu", "kodu", "thanga", "eppadi", "yaar", "yaaru", "neram", "vanthu", "panna", "edutha", "paatha", "ke", "ki", "ka", "ko", "dikhao", "karo", "hai", "kahan", "mera", "meri", "chahiye", "wali", "wale", "tasveerein", "tasveer", "mujhe", "dhundo", "bhejo", "lao", "kal", "aaj", "wala", "bhi", "tha", "thi", "raha", "rahe", "dedo", "karna", "aur", "sab", "sabhi", "chupinchu", "yokka", "ekkada", "unnayi", "naaku", "kaanikku", "ude", "evide", "enikku"]
#: Scripts from Devanagari to Malayalam.
INDIC = r"[\x{0900}-\x{0D7F}]"
#: Fusion weights of (image, lexical, dense, filename) by intent.
INTENT_WEIGHTS = {"academic": (0.0, 0.35, 0.20, 0.45), "visual": (0.60, 0.15, 0.10, 0.15), "general": (0.15, 0.35, 0.25, 0.25)}

PREPOSITIONS = ["in", "with", "wearing", "on", "at", "near", "holding", "by", "under", "beside", "of"]
SUBJECTS = ["guy", "man", "woman", "girl", "boy", "person", "people", "child", "children", "baby", "elderly", "dog", "cat", "puppy", "kitten", "bird", "animal", "student", "teacher", "character", "hero", "superhero", "friend", "selfie", "someone", "somebody", "men", "women"]
CLOTHING = ["dress", "shirt", "t-shirt", "tshirt", "jacket", "pants", "suit", "sweater", "cardigan", "hoodie", "coat", "jeans", "shorts", "skirt", "saree", "kurta", "jersey", "uniform", "socks", "shoes", "hat", "cap", "backpack", "bag", "glasses", "sunglasses", "outfit", "costume", "garment", "cloth", "tie", "scarf", "vest"]
SCENES = ["grass", "park", "kitchen", "beach", "street", "city", "room", "skyline", "ground", "field", "outdoor", "indoor", "forest", "office", "snow", "water", "sea", "mountain", "table", "floor", "wall", "background"]
ACTIONS = ["wearing", "holding", "sitting", "standing", "walking", "running", "carrying", "riding", "driving", "posing", "eating", "cooking", "reading", "looking", "taking"]
ATTRIBUTES = ["red", "blue", "green", "yellow", "orange", "purple", "pink", "brown", "black", "white", "gray", "grey", "cyan", "maroon", "gold", "golden", "silver", "dark", "light", "bright", "striped", "plain", "knitted", "leather", "wooden", "metal", "cooked", "fresh", "big", "small", "tall", "short", "young", "old", "vintage", "modern", "casual", "formal"]

#: Words of a query's subject and the forms that stand for it in evidence.
SUBJECT_SYNONYMS = {
    "guy": ["guy", "man", "boy", "person", "adult", "male"], "man": ["man", "guy", "adult", "person", "male"], "woman": ["woman", "lady", "girl", "person", "female"],
    "person": ["person", "man", "woman", "guy", "boy", "girl", "individual", "adult"], "child": ["child", "kid", "baby", "boy", "girl", "toddler"],
    "baby": ["baby", "infant", "newborn"], "dog": ["dog", "puppy", "canine", "hound"], "cat": ["cat", "kitten", "feline"],
}
CLOTHING_SYNONYMS = {
    "shirt": ["shirt", "t-shirt", "tshirt", "top", "tee"], "dress": ["dress", "gown", "frock"], "jacket": ["jacket", "coat", "blazer", "hoodie", "windbreaker"],
    "pants": ["pants", "trousers", "jeans", "slacks"], "suit": ["suit", "tuxedo"], "sweater": ["sweater", "cardigan", "pullover"],
    "backpack": ["backpack", "bag", "rucksack", "knapsack"], "jersey": ["jersey", "uniform", "kit"], "shorts": ["shorts"], "skirt": ["skirt"],
    "shoes": ["shoes", "sneakers", "boots", "footwear"], "hat": ["hat", "cap", "beanie"],
}
#: Words that a subject of a query stands for.
SUBJECT_FORMS = {
    "guy": ["guy", "man", "person"], "man": ["man", "guy", "person"], "woman": ["woman", "lady", "girl", "person"], "girl": ["girl", "woman", "person"],
    "boy": ["boy", "guy", "person", "child"], "person": ["person", "man", "woman", "individual"], "child": ["child", "kid", "baby", "boy", "girl"],
    "baby": ["baby", "infant", "newborn", "child"], "dog": ["dog", "canine", "puppy", "hound"], "cat": ["cat", "feline", "kitten"],
}
#: Objects that are worn, by the words in their names.
GARMENTS = ["dress", "shirt", "t-shirt", "tshirt", "jacket", "pants", "suit", "sweater", "cardigan", "hoodie", "coat", "jeans", "shorts", "skirt", "saree", "kurta", "jersey", "uniform", "sock", "socks", "shoes", "hat", "cap", "glove", "gloves", "vest", "tie", "scarf", "outfit", "costume", "garment", "cloth", "stripes"]
COSTUMES = ["spider-man suit", "superhero suit", "costume", "vulture suit"]
#: Attributes beside colours that bind to the noun after them.
MATERIALS = ["striped", "knitted", "leather", "wooden", "metal", "cooked", "fresh"]
SCENE_TAGS = ["outdoor", "indoor", "urban", "nature", "snow", "kitchen", "street"]
STOP_WORDS = ["a", "an", "the", "in", "on", "at", "to", "for", "of", "by", "with", "and", "or", "is", "it", "as", "from", "into", "onto", "my", "me", "this", "that", "these", "those"]
SHORT_NAMES = ["ai", "ml", "ui", "ux", "os", "id", "qa", "db", "vr", "ar", "cv", "ip"]
#: Words after an attribute that name no object.
PLAIN_NOUNS = ["file", "filename", "content", "document", "text", "folder", "code", "script"]
ARTICLES = ["a", "an", "the"]
ASSIGNMENT = r"(?i)\b(da|la|lab|assignment|assessment)\s*[-_]?\s*(\d+)\b"
#: Words in a file's type that put it into a category.
TYPE_WORDS = {
    "document": ["pdf", "word", "document", "text", "sheet", "presentation", "markdown"], "image": ["image", "photo", "picture", "jpeg", "png", "webp", "gif"],
    "video": ["video", "movie", "clip", "mp4", "mkv", "avi"], "audio": ["audio", "sound", "music", "song", "voice", "recording"],
    "code": ["source", "code", "script", "program", "python", "javascript", "typescript", "c++", "java"], "archive": ["archive", "zip", "compressed", "tar", "rar"],
}
