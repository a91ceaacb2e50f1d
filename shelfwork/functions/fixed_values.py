"""Results depend on exactly these words, patterns and limits."""

# Replacement table for common mis-decoded letters, in order.
MOJIBAKE = [
    ("Ã©", "é"), ("Ã¨", "è"), ("Ãª", "ê"), ("Ã«", "ë"),
    ("Ã ", "à"), ("Ã¢", "â"), ("Ã§", "ç"),
    ("Ã´", "ô"), ("Ã¹", "ù"), ("Ã»", "û"),
    ("Ã¯", "ï"), ("Ã®", "î"),
    ("Å\"", "œ"), ("Ã†", "Æ"),
    ("â€™", "'"), ("â€œ", "\""), ("â€", "\""),
    ("â€\"", "-"),
    ("Â", ""), ("Ã", ""),
]

# White space of all scripts (as Python's str.isspace has it), for character classes.
# Written out, because \s means ASCII only in some engines and not in others.
WHITE_LETTERS = "\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WHITE = f"[{WHITE_LETTERS}]"
NOT_WHITE = f"[^{WHITE_LETTERS}]"

# Patterns of the cleaning chain.
TAGS = "<[^>]+>"
WEB_WORDS = f"http{NOT_WHITE}+|www{NOT_WHITE}+"
EMAILS = f"{NOT_WHITE}+@{NOT_WHITE}+"
ENTITIES = "&[a-z]+;"
OUTSIDE_CHARSET = rf"[^a-zA-Z0-9{WHITE_LETTERS}.,!?;:\-àâäéèêëïîôùûüÿçÀÂÄÉÈÊËÏÎÔÙÛÜŸÇ]"
SPACES = f"{WHITE}+"

# Patterns of the model text.
SPACED_MARKS = "([?;!,¿])"
QUOTES_AND_SPACES = "[\" ]+"
OUTSIDE_MODEL_TEXT = "[^a-zA-Z0-9.°()]+"

# Web addresses of the baseline chain.
WEB_ADDRESSES = (
    r"((http\://|https\://|ftp\://)|(www.))+"
    r"(([a-zA-Z0-9\.-]+\.[a-zA-Z]{2,4})|([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}))"
    r"(/[a-zA-Z0-9%:/-_\?\.'~]*)?"
)

# Possessive endings, removed in this order.
POSSESSIVES = ["'s", "’s", "\\'s", "\\’s"]

# ASCII punctuation.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# Characters that separate words of the vocabulary.
WORD_SEPARATORS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# Prefixes of model replies.
REPLY_PREFIXES = "(?i)^(Translation:|English:|Here is the translation:)\\s*"

# Numbered replies, strict and loose grammar.
NUMBERED_LINE = r"(?sm)^(\d+)[\.\)\-]\s*(.+?)(?=^\d+[\.\)\-]|\z)"
NUMBERED_INLINE = r"(?sm)(\d+)\.+\s(.*?)(?=\n\d+\.+|\z)"

# Batch size by number of words.
LENGTH_CLASSES = [("short", 200, 5), ("medium", 500, 3), ("long", 2000, 2), ("very_long", None, 1)]

# Verdicts on validation accuracy and on the over-fitting gap.
ACCURACY_BANDS = [(0.65, "excellent"), (0.58, "good"), (0.52, "modest")]
GAP_BANDS = [(0.15, "significant"), (0.08, "moderate")]

# English contractions, in matching order. The same entries with a
# curly apostrophe follow by rule.
CONTRACTIONS = {
    "ain't": "am not", "aren't": "are not", "can't": "cannot", "can't've": "cannot have",
    "'cause": "because", "could've": "could have", "couldn't": "could not",
    "couldn't've": "could not have", "didn't": "did not", "doesn't": "does not",
    "don't": "do not", "hadn't": "had not", "hadn't've": "had not have",
    "hasn't": "has not", "haven't": "have not", "he'd": "he had", "he'd've": "he would have",
    "he'll": "he will", "he'll've": "he will have", "he's": "he is", "how'd": "how did",
    "how'd'y": "how do you", "how'll": "how will", "how's": "how is", "i'd": "i would",
    "i'd've": "i would have", "i'll": "i will", "i'll've": "i will have", "i'm": "i am",
    "i've": "i have", "isn't": "is not", "it'd": "it would", "it'd've": "it would have",
    "it'll": "it will", "it'll've": "it will have", "it's": "it is", "let's": "let us",
    "ma'am": "madam", "mayn't": "may not", "might've": "might have",
    "mightn't": "might not", "mightn't've": "might not have", "must've": "must have",
    "mustn't": "must not", "mustn't've": "must not have", "needn't": "need not",
    "needn't've": "need not have", "o'clock": "of the clock", "oughtn't": "ought not",
    "oughtn't've": "ought not have", "shan't": "shall not", "sha'n't": "shall not",
    "shan't've": "shall not have", "she'd": "she would", "she'd've": "she would have",
    "she'll": "she will", "she'll've": "she will have", "she's": "she is",
    "should've": "should have", "shouldn't": "should not", "shouldn't've": "should not have",
    "so've": "so have", "so's": "so is", "that'd": "that would",
    "that'd've": "that would have", "that's": "that is", "there'd": "there would",
    "there'd've": "there would have", "there's": "there is", "they'd": "they would",
    "they'd've": "they would have", "they'll": "they will", "they'll've": "they will have",
    "they're": "they are", "they've": "they have", "to've": "to have", "wasn't": "was not",
    "we'd": "we would", "we'd've": "we would have", "we'll": "we will",
    "we'll've": "we will have", "we're": "we are", "we've": "we have",
    "weren't": "were not", "what'll": "what will", "what'll've": "what will have",
    "what're": "what are", "what's": "what is", "what've": "what have",
    "when's": "when is", "when've": "when have", "where'd": "where did",
    "where's": "where is", "where've": "where have", "who'll": "who will",
    "who'll've": "who will have", "who's": "who is", "who've": "who have",
    "why's": "why is", "why've": "why have", "will've": "will have", "won't": "will not",
    "won't've": "will not have", "would've": "would have", "wouldn't": "would not",
    "wouldn't've": "would not have", "y'all": "you all", "y'all'd": "you all would",
    "y'all'd've": "you all would have", "y'all're": "you all are",
    "y'all've": "you all have", "you'd": "you would", "you'd've": "you would have",
    "you'll": "you will", "you'll've": "you will have", "you're": "you are",
    "you've": "you have",
}

# A short list of English function words; callers may pass their own.
STOP_WORDS = (
    "a about after all also am an and any are as at be because been before being but by can "
    "could did do does for from had has have he her here him his how i if in into is it its "
    "just me more most my no not of on once only or other our out over same she so some such "
    "than that the their them then there these they this those through to too under until up "
    "very was we were what when where which while who whom why will with would you your"
).split()
