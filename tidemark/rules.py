"""Word lists, patterns, weights and thresholds.

Everything in this module is data.  The values must equal the published
behaviour being reproduced, so they are stated plainly and in their natural
order.  Patterns are written in a portable dialect (``\\b`` and ``\\s`` only) and
compiled by :mod:`tidemark.functions.regex`.  Institution names are not listed;
functions that need them take them as parameters.
"""

# ---------------------------------------------------------------- language ID
# Fixed values.
CIRCUMFLEX = "[âêîôûŵŷ]"
ORTHOGRAPHY = r"[âêîôûŵŷ]|\b(?:ll|rh|dd|ff|ngh|mh|nh)|\b(?:gwyr|gwybod|ydyn|mewn|wyf|wyd|yr|yng|ym)\b"
DIACRITIC_WIDE = "[ŵŷâêîôûẁỳẃýÿï]"

# One hit decides the language.
FUNCTION_WORDS = (
    "yr yn yng ym drwy wrth "
    "ti ni chi nhw eu ein dy fy eich "
    "mae oes ydy yw oedd roedd bydd fydd "
    "gall gallaf hoffwn hoffaf eisiau moyn "
    "dw dwi rwy rydw rydych maen "
    "beth pwy ble pryd pam sut faint sawl "
    "ac ond achos oherwydd hefyd nawr dim nid nad "
    "prifysgol coleg myfyriwr myfyrwyr darlith cwrs "
    "modiwl gradd campws llety ffioedd "
    "shwmae shwmai prynhawn dda"
).split()

# English words never counted as vocabulary hits; the institution's own
# names are a parameter.
ENGLISH_STOP = (
    "a an the and or but if of in on at to for with from by as is are was were "
    "be been being have has had do does did will would should could may might must can "
    "i you he she it we they me him her us them my your his its our their "
    "this that these those what when where why who how which "
    "no not yes all any some more most less hello hi hey thanks please ok okay "
    "course courses fee fees module modules campus library student students uni university "
    "help tell show give make take get go come find see know think want need like feel "
    "today tomorrow yesterday now then here there good bad new old first last next previous "
    "year years day days week weeks month months time money people person thing things way ways "
    "about after before between during into over through under until while without "
    "deadline exam exams essay essays assignment assignments lecture lectures tutor tutors "
    "computing engineering business law art design "
    "write twitter data python script scrape code programme program api api'r json csv html css "
    "javascript java ruby rust linux windows mac internet web website url link click open close "
    "google facebook instagram linkedin youtube reddit video audio image photo file folder document "
    "ucas bbc nhs uk us"
).split()

# Answer filter (one diacritic or two of these words).
ANSWER_WORDS = (
    "yr y yn ac a ar am at i o mewn gan "
    "mae ydy yw oedd fydd bydd cael wedi wrth "
    "chi ti fi ni nhw ef hi fo "
    "dw dwi rwy rydw rydych rydyn rwyt "
    "beth pam pryd ble pwy sut faint "
    "shwmae helo diolch croeso iawn ddim "
    "prifysgol myfyriwr cymraeg cymru cwrs ffioedd"
).split()

# Default word classes of the scored detector.  The full vocabularies are a
# parameter (a table); these closed-class cores are the default.
SCORED_STRONG = (
    "shwmae shwmai helo helô diolch hwyl bore prynhawn noswaith nos "
    "dwi rwyf rwy ydw ydy yw cymraeg cymru caerfyrddin abertawe llambed caerdydd "
    "myfyriwr myfyrwyr prifysgol llyfrgell llety ffioedd bwrsari neuaddau "
    "cwrs cyrsiau modiwl darlith graddio cofrestru anabledd lles cymorth "
    "sut pam ble pryd pwy pa faint beth sawl oedd fydd bydd hefyd wrth oherwydd"
).split()
SCORED_WELSH = (
    "mae oes wyt gall gallaf gallwch hoffwn cael mynd dod gwneud helpu gofyn "
    "gyda gydag drwy trwy dros rhwng achos gan dan tan heb mewn "
    "nawr ond neu fel pan felly wedyn eto mwy llai mawr bach newydd "
    "fi mi ti chi nhw fe ni ef fy dy ei ein eich eu hwn hon hyn yr rhai pob dim nid rhaid "
    "eisiau moyn angen croeso iawn gwych"
).split()
SCORED_ENGLISH = (
    "how where when why what which who your you my our their this that these those there here "
    "me he she it we they us him her them can could would should will shall may might must "
    "do does did have has had is are was were been being get make take go come see look use "
    "the a an and or but if so nor yet with from about into over under after before because "
    "between through during in on at by up off out for of to help please thanks hello hi hey "
    "need want find tell show time day week month year good bad new old first last next any some "
    "apply application student students university campus course courses fee fees support service"
).split()
# English endings looked for on unclassified words.
ENGLISH_SUFFIX = "(ing|tion|tions|ings|ness|ment|ments|ed|ly)$"

# Reply-language checks.
REPLY_FUNCTION = (
    r"\b(yw|ydy|ydw|mae|y|yr|yn|ar|i|o|a'r|neu|sy|sydd|eich|ein|dy|fy|gallaf|gallwch|gellir|"
    r"hoffech|dydw|ddim|gan|gyda|am|drwy|hyn|hwn|hon|dyna|dyma|ac|ond|os|pob|bob|hefyd|iawn|"
    r"rhyngwladol|cartref|myfyrwyr|ffioedd|llety|llyfrgell|cymorth|cysylltwch|ewch|defnyddia)\b"
)
REPLY_DIGRAPH = r"\b\w*(ll|dd|ff|ch|rh|ng|wy|ys)\w*\b"
REPLY_ENGLISH = (
    r"\b(the|and|of|is|are|for|with|to|from|you|your|can|please|please contact|students|university)\b"
)
REPLY_TOKENS = (
    "yr yn yng ym ydw rwy rwyt rydych rydw rydyn mae maen ydy ydyw yw oes wyt wyf "
    "bydd fydd oedd roedd byddai fyddai chi chwi ti fi ni nhw fy dy eich ein "
    "eu fe fo hi hwn hon hyn hynny beth pwy ble pryd pam sut faint sawl "
    "ond achos oherwydd hefyd nawr felly dim nid nad ddim drwy wrth gan dros tan "
    "prifysgol myfyriwr myfyrwyr cwrs cyrsiau modiwl gradd campws llety ffioedd darlith darlithoedd "
    "shwmae shwmai helo helô diolch croeso gallaf hoffwn eisiau moyn i'r ar y"
).split()
REPLY_LEADS = "helo helô shwmae shwmai bore noswaith prynhawn diolch croeso dyma dyna".split()

# ------------------------------------------------------------------- stoplists
# Fixed values.
EN_STOP = (
    "the a an is are was were be been being have has had "
    "do does did will would shall should may might must can could "
    "to of in on at for with by from about into through "
    "i me my we our you your he his she her it its they their "
    "what which who this that these those am not no so if or "
    "and but how when where why please want need help tell know "
    "get like just also more some any all very really actually "
    "im ive id ill cant dont doesnt isnt arent wasnt wont havent"
).split()
CY_STOP = (
    "y yr a ac ar at i o am dan dros drwy heb tan wrth "
    "yn ym yng eu ein ei fy dy eich yw ydy mae oedd roedd "
    "bydd fydd bod oes sydd sy hefyd dim nid os neu ond fel "
    "pan nad rwy rwyf rydw dw dwi chi ni nhw fe hi ef"
).split()
GROUNDING_STOP = (
    "the a an is are was were be been being have has had "
    "do does did will would shall should may might must can could "
    "to of in on at for with by from about into through "
    "and but or so if that this these those there here not "
    "you your they their them we our us he his she her i me my "
    "what which who when where why how also just some any all "
    "more most many much over such than then only own same each"
).split()
RERANK_STOP = (
    "the a an is are was were be been have has had do does did "
    "to of in on at for with by from and or but so if "
    "i you he she it we they me my your his her our their "
    "what which who when where why how this that these those "
    "can could would should may might will shall must about "
    "am pm mae oes sut beth ble pryd pam faint ydy yw dw rwy"
).split()
KEYWORD_STOP = (
    "a an the i me my we you your is am are was were be been being "
    "do does did to of in on at for by with from that this these those "
    "and or but so as if it its they them their there then than about "
    "have has had how what where when why who which can could should would "
    "will just also like please thanks thank help need want know tell say "
    "really still yet now here some any all each every no not too very "
    "get got go going come make made take took give gave find found okay ok yes"
).split()
COMMENT_STOP = (
    "the and a is to of for with in on it that this i you my we are was be but not no or so an as "
    "at by from have had has if me our your their they them there when why how what where also more "
    "some any just like really very too get got can could would should will did do does done than "
    "then into about because while only"
).split()
TERM_STOP = (
    "the and or of in to a an is are was were for with by at on from this that have has not "
    "be as it its but if do did so up out can all one two three four five six had they them "
    "their our we he she you my me him her us per may use act set new age end day men man "
    "yes no non sub pre pro via see any how"
).split()
# Words that carry no topic in a fact or a question about one.
FACT_STOP = (
    "a an the is are was were be been am do does did "
    "i you he she it we they me my your his her our their "
    "to of in on at for with from by as and or but so "
    "this that these those what when where why how which who whom "
    "not no yes can could would should will may might "
    "about there into please pls plz ok okay uh um hi hello hey "
    "feeling feel feels felt really very quite so just bit little "
    "need want get got have having has going trying hard "
    "im ive id ill dont cant wont isnt arent wasnt help helps helping "
    "right now ok okay fine sure good bad like talk see "
    "find found look looking learn know tell show get go "
    "information info details more something anything everything "
    "i y yr yn ar o am fy dy ei eu ein eich a ac ond "
    "dw rwy rwyf ydw ydy yw ond mae oes beth ble pryd pam sut faint "
    "ti chi fo fe hi nhw chdi eich yr hwn hon hwnna hwnnw honno "
    "plis helo helô shwmae shwdi teimlo teimla teimlaf teimlol "
    "wir iawn hefyd nawr rwan eisiau isie isio moyn angen cael"
).split()

# ---------------------------------------------------------------- corpus filters
# Fixed values.  The stems inside \b..\b never match longer words; kept as is.
RELEVANT_STUDY = (
    r"\b(universit|college|student|tuition|lecture|professor|semest|degree|bachelor|master|phd|"
    r"dissertation|thesis|assignment|essay|coursework|deadline|exam|assessment|accommodation|campus|"
    r"library|module|curriculum|enrollment|scholarship|grant|loan|financial aid|bursary|fees|"
    r"wellbeing|mental health|stress|anxiety|support service|career|internship|placement|graduate|"
    r"alumni|application|ucas|personal statement|interview|offer|study skills|revision|research|"
    r"academic|explain|how does|what is|why is|define|describe|help me understand|step.by.step|"
    r"summarise|summarize)\b"
)
RELEVANT_GENERAL = (
    r"\b(math|maths|algebra|calculus|geometry|trigonometry|statistic|physics|chemistry|biology|"
    r"science|astronomy|geology|history|geography|politic|economic|philosophy|psychology|sociolog|"
    r"english|literature|grammar|language|linguistic|computer|computing|programming|software|"
    r"algorithm|data|engineering|architect|design|art|music|theatre|theater|film|law|medicine|"
    r"nursing|health|nutrition|universit|college|student|tuition|lecture|professor|semest|degree|"
    r"bachelor|master|phd|dissertation|thesis|assignment|essay|coursework|deadline|exam|assessment|"
    r"scholarship|grant|loan|financial aid|bursary|fee|explain|how does|what is|why is|define|"
    r"describe|when did|who was|who is|where is|meaning of|difference between|how to|compare|list|"
    r"summari[sz]e)\b"
)
# Fixed values: (name, min chars, max chars).
LENGTH_BANDS = [
    ("long_answer", 80, 1200),
    ("short_answer", 12, 800),
    ("question", 8, 400),
    ("chat_question", 8, 500),
    ("chat_answer", 30, 1500),
]
MIN_PAGE_CHARS = 80
MIN_PASSAGE_CHARS = 41
PAGE_TEXT_CHARS = 12000
TITLE_CHARS = 80

# Lexicon admission.
LEXICON_SKIP = (
    "helo shwmae shwmai diolch croeso hwyl iawn bore prynhawn nos tywydd hyfryd drwg "
    "yfory heddiw ddoe neithiwr"
).split()
# The admission vocabulary is a parameter; this is its default core.
LEXICON_TOPICS = (
    r"\b(prifysgol|coleg|ysgol|myfyriwr|myfyrwyr|darlith|cwrs|cyrsiau|modiwl|gradd|traethawd|"
    r"aseiniad|astudio|ymchwil|arholiad|asesiad|tiwtor|tymor|amserlen|hanes|iaith|busnes|celf|"
    r"addysg|ffi|ffioedd|cost|grant|llety|neuadd|campws|llyfrgell|lles|cymorth|iechyd|cais|UCAS|"
    r"mynediad|gyrfa|swydd|gwaith|dysgu|deall|sgiliau|darllen|gwybodaeth|gwefan|data|app|cymru|"
    r"amser|problem|ateb|cwestiwn|newydd|hen|her|rhyngwladol|fisa|ffurflen|dogfen)\b"
)
LEGISLATION = r"\b(act|order|regulation|regulations|cymraeg|saesneg)\b"

# ------------------------------------------------------------------ turn rules
# Ordered, first match wins.
EMOTIONS = [
    ("distressed", r"\b(can't\s+cope|want\s+to\s+give\s+up|suicid|self[-\s]?harm|breakdown|panic\s+attack|crisis|hopeless|methu\s+ymdopi|argyfwng)\b"),
    ("stressed", r"\b(stressed|stressing|overwhelmed|anxious|anxiety|burn[-\s]?out|exhausted|can't\s+sleep|dissertation|deadline|exam\s+stress|gorlethu|straen|pryder)\b"),
    ("frustrated", r"\b(frustrated|annoyed|fed\s+up|useless|terrible|awful|stupid|broken|not\s+working|trash|rubbish|hate\s+this|rhwystredig|wedi\s+cael\s+llond\s+bol)\b"),
    ("confused", r"\b(confused|don't\s+understand|what\s+does\s+that\s+mean|lost|makes\s+no\s+sense|can\s+you\s+explain|dw[iy]?\s+ddim\s+yn\s+deall|dryslyd)\b"),
    ("excited", r"\b(excited|can't\s+wait|amazing|awesome|brilliant|love\s+it|so\s+happy|cyffrous|gwych|anhygoel)\b"),
]
# Wider register table, several patterns per label.
EMOTIONS_WIDE = [
    ("distressed", r"\b(want\s+to\s+(?:die|quit|drop\s*out|give\s*up))\b"),
    ("distressed", r"\b(can(?:'|)?t\s+cope|cant\s+cope|breaking\s+down|falling\s+apart|can(?:'|)?t\s+do\s+this(?:\s+any\s*more)?)\b"),
    ("distressed", r"\b(suicidal|hopeless|no\s+point|rock\s+bottom|crisis|desperate)\b"),
    ("distressed", r"\b(wedi\s+cael\s+digon|methu\s+ymdopi|methu\s+dal\s+ati)\b"),
    ("stressed", r"\b(stressed|stressful|anxious|anxiety|worried|worries|worrying|panic|panicking|panick?ed|overwhelmed|overwhelm|burn(?:t|ed)?\s*out|exhausted|drained|scared|terrified)\b"),
    ("stressed", r"\b(too\s+much|can(?:'|)?t\s+sleep|losing\s+sleep|pressure|deadline\s+is\s+killing)\b"),
    ("stressed", r"\b(wedi\s+blino|ofnus|pryderus|dan\s+bwysau|straen)\b"),
    ("frustrated", r"\b(frustrated|frustrating|annoyed|annoying|angry|mad|furious|pissed|fed\s*up|sick\s+of|tired\s+of|ridiculous|useless|waste\s+of\s+time|rubbish|terrible|awful)\b"),
    ("frustrated", r"\b(you('|\s*a)re?\s+(?:not\s+)?(?:understanding|helping|wrong)|asked\s+(?:this|that)\s+already|already\s+asked)\b"),
    ("frustrated", r"\b(wedi\s+laru|dig|blin|dwp)\b"),
    ("confused", r"\b(confused|confusing|don'?t\s+(?:get|understand)|doesn'?t\s+make\s+sense|makes?\s+no\s+sense|lost|unclear|not\s+sure\s+what)\b"),
    ("confused", r"\b(what\s+(?:do\s+you\s+mean|does\s+that\s+mean)|can\s+you\s+explain)\b"),
    ("confused", r"\b(dydw\s+i\s+ddim\s+yn\s+deall|methu\s+deall|ar\s+goll)\b"),
    ("excited", r"\b(excited|can(?:'|)?t\s+wait|so\s+happy|thrilled|pumped|love\s+it|amazing|awesome|brilliant|fantastic|yay)\b"),
    ("excited", r"\b(cyffrous|methu\s+aros|mor\s+hapus|gwych|bendigedig)\b"),
]

# Profile slots.
NAME = r"\b(?:i'?m|my\s+name\s+is|i\s+am)\s+([A-Z][a-zA-Z'-]{1,20})\b"
COURSES = [
    (r"\b(applied\s+computing|computer\s+science|computing)\b", "computing"),
    (r"\b(cyber|cybersecurity)\b", "cyber security"),
    (r"\b(games\s+design|game\s+dev|game\s+development)\b", "games"),
    (r"\b(nursing|midwifery)\b", "nursing"),
    (r"\b(business|management|mba)\b", "business"),
    (r"\b(psychology)\b", "psychology"),
    (r"\b(engineering|mechanical|electrical|civil|automotive)\b", "engineering"),
    (r"\b(art|fine\s+art|graphic\s+design|fashion)\b", "art & design"),
    (r"\b(film|acting|performing\s+arts|drama)\b", "performing arts"),
    (r"\b(education|pgce|teacher|teaching)\b", "education"),
    (r"\b(law|criminology)\b", "law"),
    (r"\b(architecture|construction)\b", "architecture"),
    (r"\b(sport|fitness|coaching)\b", "sport"),
]
LEVEL = r"\b(undergrad(uate)?|postgrad(uate)?|foundation|masters?|phd|mba|pgce)\b"
YEAR = r"\b(first|second|third|fourth|final|1st|2nd|3rd|4th)\s+year\b"
CAMPUS = r"\b(swansea|carmarthen|lampeter|cardiff|sa1|mount\s+pleasant|townhill)\b"
TOPICS = [
    (r"\b(accommodation|halls|residence|neuadd|llety)\b", "accommodation"),
    (r"\b(fee|tuition|cost|price|bursary|scholarship)\b", "fees"),
    (r"\b(library|llyfrgell|study\s+space)\b", "library"),
    (r"\b(wellbeing|stress|mental|support|counsel)\b", "wellbeing"),
    (r"\b(wifi|moodle|password|login|portal)\b", "it"),
    (r"\b(campus|carmarthen|lampeter|swansea|cardiff)\b", "campus"),
    (r"\b(apply|application|ucas|offer|entry|clearing)\b", "admissions"),
    (r"\b(graduation|ceremony|graddio)\b", "graduation"),
    (r"\b(placement|internship|work\s+experience)\b", "placement"),
    (r"\b(society|club|union|sport)\b", "student life"),
    (r"\b(visa|international|tier\s+4)\b", "international"),
    (r"\b(timetable|lecture|class|module)\b", "academics"),
    (r"\b(exam|assessment|coursework|deadline)\b", "assessment"),
    (r"\b(job|career|employability)\b", "careers"),
]
TOPICS_RECENT = [
    (r"\b(accommodation|halls|residence)\b", "accommodation"),
    (r"\b(fee|tuition|cost|price|bursary|scholarship|funding|loan)\b", "fees/funding"),
    (r"\b(wellbeing|stress|anxious|mental|crisis|lonely|homesick)\b", "wellbeing"),
    (r"\b(library|study\s+space|books?|founders)\b", "library"),
    (r"\b(wifi|moodle|password|login|portal|printing|print)\b", "IT services"),
    (r"\b(timetable|class(es)?|lecture|seminar|attendance)\b", "timetable"),
    (r"\b(dissertation|thesis|research\s+project)\b", "dissertation"),
    (r"\b(assignment|coursework|submission|turnitin|deadline)\b", "assignments"),
    (r"\b(apply|application|ucas|offer|interview|entry\s+requirement|clearing)\b", "applying"),
    (r"\b(visa|cas|biometric|international)\b", "international/visa"),
    (r"\b(campus|carmarthen|lampeter|swansea|sa1|mount\s+pleasant|cardiff)\b", "campus info"),
    (r"\b(club|society|union|activit(y|ies)|social|sport)\b", "student life"),
    (r"\b(parking|bus|shuttle|travel|transport)\b", "transport"),
    (r"\b(graduation|graduating|ceremony)\b", "graduation"),
]
# Profile of the wider context extractor.
NAME_INTROS = [
    r"\bmy\s+name\s+is\s+([A-Za-z'’-]{2,20})",
    r"\bi['’]?m\s+([A-Za-z'’-]{2,20})",
    r"\bi\s+am\s+([A-Za-z'’-]{2,20})",
    r"\bthis\s+is\s+([A-Za-z'’-]{2,20})",
    r"\bcall\s+me\s+([A-Za-z'’-]{2,20})",
    r"\bfy\s+enw\s+(?:i\s+)?yw\s+([A-Za-z'’-]{2,20})",
]
BAD_NAMES = (
    "a an the student international home uk welsh english not "
    "sure confused graduating applying looking trying studying "
    "interested hoping here there new old final first second third "
    "fourth year myfyriwr rhyngwladol cartref newydd"
).split()
STUDENT_TYPES = [
    (r"\b(international|overseas|non[-\s]?uk)\s+(student|applicant|postgrad|undergrad)|\bi['’]?m\s+(an?\s+)?international\b|\bmyfyriwr\s+rhyngwladol\b", "international"),
    (r"\b(uk|home|welsh|domestic)\s+(student|applicant)|\bi['’]?m\s+(a\s+)?(uk|home|welsh)\s+(student|applicant)|\bmyfyriwr\s+cartref\b", "home"),
]
LEVELS_WIDE = [
    (r"\b(post.?grad(uate)?|masters?|phd|doctoral|doctorate|mphil|pgce)\b", "postgraduate"),
    (r"\b(undergrad(uate)?|bachelors?|first\s+degree)\b", "undergraduate"),
]
YEARS_WIDE = [
    (r"\b(graduating|graduation|graduate)\s+(this\s+year|this\s+summer|soon|in\s+(july|december)|eleni)\b|\b(i['’]?m|i\s+am)\s+(graduating|graduation)\b|\b(rwy['’]?n|dw\s+i['’]?n)\s+graddio\s+eleni\b", "graduating"),
    (r"\b(final\s+year|last\s+year)\b", "final-year"),
    (r"\b(first\s+year|fresher|just\s+started)\b", "first-year"),
    (r"\b(second\s+year)\b", "second-year"),
    (r"\b(third\s+year)\b", "third-year"),
]
CAMPUS_WIDE = r"\b(?:at|on|in|based\s+(?:at|in))\s+(Swansea|Carmarthen|Lampeter|Cardiff|Birmingham|Llambed|Caerfyrddin|Abertawe|Caerdydd)\b"
CAMPUS_NAMES = {"llambed": "Lampeter", "caerfyrddin": "Carmarthen", "abertawe": "Swansea", "caerdydd": "Cardiff"}
COURSES_WIDE = [
    (r"\b(applied\s+computing|computer\s+science|computing)\b", "Computing"),
    (r"\b(nursing|midwifery|healthcare)\b", "Nursing / Healthcare"),
    (r"\b(business|management|mba|marketing|accounting|finance)\b", "Business"),
    (r"\b(psychology|counselling|social\s+work)\b", "Psychology / Counselling"),
    (r"\b(engineering|mechanical|electrical|civil|automotive)\b", "Engineering"),
    (r"\b(art(?:s)?\s+(and|&)\s+design|fine\s+art|graphic\s+design)\b", "Art & Design"),
    (r"\b(games\s+(art|design)|animation)\b", "Games / Animation"),
    (r"\b(film|acting|performing\s+arts|drama|theatre)\b", "Film / Performing Arts"),
    (r"\b(education|teacher\s+training|pgce|teaching)\b", "Education / Teaching"),
    (r"\b(law|criminology)\b", "Law"),
    (r"\b(architecture|built\s+environment|construction)\b", "Architecture / Construction"),
    (r"\b(sport|fitness|coaching)\b", "Sport"),
    (r"\b(tourism|hospitality|event(s)?\s+management)\b", "Tourism / Hospitality"),
]

# Intent boosts from recent history (pattern, tag fragments).
COURSE_BOOSTS = [
    (r"\b(applied\s+computing|computer\s+science|computing|cyber|games)\b", ["comput", "cyber", "games"]),
    (r"\b(nursing|midwifery|healthcare)\b", ["nursing", "health"]),
    (r"\b(business|management|mba|marketing|finance|accounting)\b", ["business", "mba"]),
    (r"\b(psychology|counselling|social\s+work)\b", ["psychology", "counsell", "social_work"]),
    (r"\b(engineering|mechanical|electrical|civil|automotive)\b", ["engineer"]),
    (r"\b(art|design|graphic|fine\s+art|fashion)\b", ["art", "design"]),
    (r"\b(film|acting|performing\s+arts|drama|theatre)\b", ["film", "acting", "performing"]),
    (r"\b(education|teacher|pgce|teaching)\b", ["education", "pgce", "teach"]),
    (r"\b(law|criminology)\b", ["law", "crimin"]),
    (r"\b(architecture|construction|built\s+environment)\b", ["architect", "construct"]),
    (r"\b(sport|fitness|coaching)\b", ["sport", "fitness"]),
]
FAMILY_BOOSTS = [
    ("accommodation", r"\b(accommodation|halls|residence|neuadd|llety)\b"),
    ("fees", r"\b(fee|tuition|cost|price|ffioedd|scholarship|bursary)\b"),
    ("wellbeing", r"\b(wellbeing|stress|anxious|mental|lles|support|crisis)\b"),
    ("it", r"\b(wifi|moodle|password|login|portal)\b"),
    ("library", r"\b(library|llyfrgell|book|study\s+space|founders)\b"),
    ("campus", r"\b(campus|carmarthen|lampeter|swansea|sa1|townhill|cardiff)\b"),
    ("apply", r"\b(apply|application|ucas|offer|entry\s+requirement|clearing)\b"),
    ("graduation", r"\b(graduation|graduating|ceremony|graddio)\b"),
]
BOOST_COURSE, BOOST_OTHER_COURSE, BOOST_FAMILY, BOOST_ENTITY = 2.5, 0.3, 1.5, 1.4

# Entity patterns (pattern, type, normal form).
ENTITIES = [
    (r"\b(abertawe|swansea)\b", "LOCATION", "swansea"),
    (r"\b(caerfyrddin|caerfyrdd|nghaerfyrddin|gaerfyrddin|carmarthen)\b", "LOCATION", "carmarthen"),
    (r"\b(llambed|lampeter|llanbed)\b", "LOCATION", "lampeter"),
    (r"\b(aberystwyth)\b", "LOCATION", "aberystwyth"),
    (r"\b(moodle|mwdl)\b", "SYSTEM", "moodle"),
    (r"\b(wifi|wi-fi|rhyngrwyd)\b", "SYSTEM", "wifi"),
    (r"\b(llyfrgell|library)\b", "FACILITY", "library"),
    (r"\b(llety|neuaddau|halls)\b", "FACILITY", "accommodation"),
    (r"\b(ffioedd|fees?)\b", "TOPIC", "fees"),
    (r"\b(lles|wellbeing)\b", "TOPIC", "wellbeing"),
    (r"\b(graddio|graduation)\b", "TOPIC", "graduation"),
    (r"\b(bwrsari|bursary)\b", "TOPIC", "bursary"),
    (r"\b(anabledd|disability)\b", "TOPIC", "disability"),
    (r"\b(argraffu|printing)\b", "TOPIC", "printing"),
    (r"\b(amserlen|timetable)\b", "TOPIC", "timetable"),
    (r"\b(undeb|union)\b", "TOPIC", "union"),
]
# Entity key -> boosted tags.
ENTITY_TAGS = [
    ("swansea", ["campuses_swansea", "library_swansea", "accommodation_general", "accommodation_cost"]),
    ("carmarthen", ["campuses_carmarthen", "library_carmarthen", "accommodation_general", "accommodation_cost"]),
    ("lampeter", ["campuses_lampeter", "library_lampeter", "accommodation_general", "accommodation_cost"]),
    ("accommodation", ["accommodation_general", "accommodation_cost"]),
    ("library", ["library", "library_swansea", "library_carmarthen", "library_lampeter"]),
    ("wifi", ["it_wifi"]),
    ("moodle", ["it_moodle"]),
    ("wellbeing", ["wellbeing_general"]),
    ("disability", ["wellbeing_disability"]),
    ("graduation", ["graduation"]),
    ("fees", ["fees_tuition", "fees_student_loan", "fees_scholarships"]),
    ("bursary", ["fees_scholarships", "financial_support"]),
    ("timetable", ["timetable"]),
    ("printing", ["printing"]),
    ("union", ["students_union"]),
]
NEGATIVE_WORDS = "ofnadwy methu ffaelu pryder straen anhapus pryderus trist ofni poeni".split()
POSITIVE_WORDS = "gwych ardderchog da hapus diolch perffaith iawn bendigedig croeso".split()

# Question types, anchored, first match wins.
QUESTION_TYPES = [
    ("LOCATION", r"^(where\b|ble mae|ble yw|location of|address of|how (do i |can i )?(get|find|reach|travel|go) to)"),
    ("QUANTITY", r"^(how much|how many|what (is|are) the (cost|fee|price|charge)|faint (yw|ydy|mae)|what does it cost)"),
    ("DATE", r"^(when|pryd|what (date|time|day|are the hours?|are (the )?opening)|opening hours?|what time does)"),
    ("PROCESS", r"^(how (do i|can i|should i|would i|to)|sut (allaf|mae|ydw|i)|what (is|are) the (process|steps?|procedure)|how (do i|can i) apply)"),
    ("PERSON", r"^(who|pwy|who (is|are|do i|should i|can i)|who (is my|are my))"),
    ("YESNO", r"^(is there|are there|oes (yna|mae)|do you have)"),
    ("DEFINITION", r"^(what (is|are|does|do)|what'?s|tell me (about|what)|explain|describe|beth (yw|ydy|mae))"),
]
# Fixed values: (question type, pattern, bonus) for sentence scoring.
ANSWER_BONUS = [
    ("LOCATION", r"[A-Z]{1,2}\d{1,2}\s*\d[A-Z]{2}", 6),
    ("LOCATION", r"\b(road|street|avenue|way|lane|waterfront|building|house)\b", 3),
    ("LOCATION", r"\b(located|situated|find us|address|directions?|junction|campus)\b", 2),
    ("LOCATION", r"\b(city centre|train station|walking distance|bus stop|park)\b", 1),
    ("QUANTITY", r"£[\d,]+", 6),
    ("QUANTITY", r"\b(per year|annually|per semester|per credit|per annum)\b", 3),
    ("QUANTITY", r"\b(fee|fees|cost|costs|price|charge|tuition|bursary|loan)\b", 2),
    ("DATE", r"\d{1,2}(am|pm|:\d{2})", 5),
    ("DATE", r"\b(monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b", 4),
    ("DATE", r"\b(january|february|march|april|may|june|july|august|september|october|november|december)\b", 3),
    ("DATE", r"\b(deadline|open|close|close[ds]?|until|by|before|from)\b", 2),
    ("PROCESS", r"@[\w.]+\.ac\.uk", 5),
    ("PROCESS", r"https?://", 4),
    ("PROCESS", r"\b(apply|contact|visit|complete|submit|email|call|register|log in|sign up|fill in|book)\b", 3),
    ("PROCESS", r"\b(step|first|then|next|finally|once|after|before)\b", 2),
    ("PERSON", r"@[\w.]+\.ac\.uk", 4),
    ("PERSON", r"\b(tutor|director|coordinator|manager|officer|adviser|team|staff|contact)\b", 3),
    ("YESNO", r"\b(available|provided|offered|accessible|free|support|service|yes|there is|there are)\b", 3),
    ("DEFINITION", r"\b(is a|are a|provides?|offers?|supports?|allows?|enables?|gives?|means?)\b", 3),
]
# Query class (sampling class label).
QUERY_CLASSES = [
    ("factual", r"\b(fee|fees|cost|price|tuition|deadline|apply|application|when|date|open|close|hours?|phone|email|address|postcode|how many|how much|list)\b", 0.15),
    ("empathetic", r"\b(feel|worry|anxious|stressed|lonely|sad|homesick|help me|advice|what should|scared|overwhelmed|scared)\b", 0.55),
]
# Query qualifiers.
QUALIFIERS = [
    ("international", r"\b(international|overseas|non[-\s]?uk|foreign\s+students?|rhyngwladol)\b"),
    ("postgraduate", r"\b(postgrad(uate)?|masters?'?|msc|mba|pg\b|pg\s+taught|ôl.raddedig|ol.raddedig)\b"),
    ("undergraduate", r"\b(undergrads?(uate)?s?|bachelors?'?|bsc|b\.?a\.?\b|foundation\s+year|ug\b|first\s+degree|israddedig)\b"),
    ("home", r"\b(home\s+students?|uk\s+students?|domestic\s+students?|home/uk|uk/home|home\s+fees?|uk\s+fees?|for\s+home\b|cartref\s+myfyrwyr?|myfyrwyr\s+y\s+du)\b"),
    ("online", r"\b(online|distance\s+learning|remote\s+study|blended\s+learning|ar.lein)\b"),
    ("parttime", r"\b(part[-\s]time|parttime|rhan.amser)\b"),
    ("phd", r"\b(phd|doctorate|doctoral|dphil|mphil|research\s+degree|doethuriaeth)\b"),
    ("pgce", r"\b(pgce|tar|teacher\s+training|postgraduate\s+certificate\s+in\s+education|tystysgrif\s+ôl.raddedig\s+mewn\s+addysg|hyfforddi\s+athrawon)\b"),
]
# Small talk.
SMALLTALK = [
    ("greeting", r"^\s*(hi|hiya|hey|hello|heya|hola|yo|sup|howdy|good\s+(morning|afternoon|evening)|morning|evening|shw+mae|shwmai|helô?|haia|bore\s+da|prynhawn\s+da|noswaith\s+dda|henffych)(\s+(there|all|everyone|bot))?[\s!.?,]*$"),
    ("how_are_you", r"^\s*(how\s+are\s+you|how'?s\s+it\s+going|how\s+are\s+things|you\s+good|sut\s+(w?yt|mae)\s+(ti|chi)|sut\s+wyt|sut\s+mae)[\s!.?]*$"),
    ("thanks", r"^\s*(thanks|thank\s+you|thx|ty|cheers|much\s+appreciated|appreciate\s+it|diolch(\s+yn\s+fawr)?|diolch\s+byth)[\s!.?]*$"),
    ("goodbye", r"^\s*(bye|goodbye|see\s+ya|see\s+you|cya|later|hwyl(\s+fawr)?|da\s+bo\s+ti|ta\s+ra)[\s!.?]*$"),
    ("who_are_you", r"^\s*(who\s+are\s+you|what\s+are\s+you|what'?s\s+your\s+name|who'?s\s+this|pwy\s+(w?yt|ydych)\s+(ti|chi)|pwy\s+wyt\s+ti|beth\s+yw'?r?\s+enw)[\s!.?]*$"),
    ("capabilities", r"^\s*(what\s+can\s+you\s+do|what\s+do\s+you\s+know|help(\s+me)?|help\s+please|beth\s+(allet|allwch|wyt|ydych)\s+.{0,20}(helpu|gwneud)|helpu(\s+fi)?)[\s!.?]*$"),
]
CRISIS = [
    "going to die", "want to die", "wanna die", "want to kill myself", "kill myself",
    "end my life", "end it all", "take my life", "take my own life",
    "dont want to live", "don't want to live", "don't want to be alive",
    "no reason to live", "not worth living", "life not worth",
    "thinking about suicide", "thinking of suicide", "suicidal", "suicide",
    "self harm", "self-harm", "selfharm", "hurt myself", "harm myself",
    "overdose", "cutting myself", "in crisis", "mental health crisis",
    "having a breakdown", "cant cope anymore", "can't cope anymore",
    "breaking down", "losing my mind",
    "eisiau marw", "eisiau lladd fy hun", "lladd fy hun", "diwedd fy mywyd",
    "meddyliau hunanladdol", "hunan-niweidio", "hunan niweidio",
    "argyfwng", "alla i ddim ymdopi",
]
CASUAL = (
    r"^(damn|dang|omg|wtf|ugh+|argh+|oh\s*no|oh\s*man|oh\s*wow|blimey|crikey|jeez|geez|yikes|shoot|crap|"
    r"phew|hmm+|lol|haha+|lmao|sigh|oof|noo+|help!*|bobl\s*bach|duw\s*annwyl|o\s*diar|wedi\s*laru|mawredd)"
    r"(\s*(man|bro|mate|dude|fam|lads|tbh))?[!?.]*$"
)
HAS_TOPIC = (
    r"\b(fee|cost|where|when|how|what|who|which|campus|course|apply|accommodation|loan|library|wifi|"
    r"moodle|timetable|submit|deadline|dissertation|assignment|tutor|wellbeing|crisis|graduat|enrol|"
    r"activit|club|sport|parking|bus|travel|print|card)\b"
)
# Follow-up triggers.
FOLLOWUPS = [
    r"^(what|how)\s+about\b",
    r"^(and|but|also)\b",
    r"^(for|in|at|to|with|about)\s+(the\s+)?[a-z]",
    r"^(it|that|they|them|these|those|this|he|she|this one|that one)\b",
    r"^(is|are|does|do|can|could|should|would|will|was|were)\s+(it|they|them|that|this)\b",
    r"^(is|are)\s+there\b",
    r"^(do|does)\s+(you|they)\s+(have|offer|provide)\b",
    r"^(when|where|how|why|who)\s+(is|are|do|does|can)\s+(it|they|them|that|this)\b",
    r"^(really|why|when|where|how|who|what)\??\s*$",
    r"^(yes|yeah|ok|okay|sure|no|nope)\b",
    r"\b(it|them|that|those|these|this one|the same|one of them)\b",
    r"^(tell me more|more|more info|more details|go on|continue|elaborate)\b",
    r"^(what else|anything else|any other)\b",
    r"^(when is|where is|how much|how long|how many)\s+(it|that|this|the)\b",
]
PRONOUN = r"\b(it|that|this|they|them|these|those|one|there)\b"
PRONOUN_SUBSTITUTE = r"\b(it|that|this|they|them|these|those|one)\b"
ELLIPTIC = [
    r"^(how much|what about|and|how long|when|where|why|who)\b",
    r"^(postgraduate|undergraduate|international|home|part-time|full-time|online)\b",
]
# Anchors.  Named services first, then general qualifiers; the
# institution's own product names are passed as further terms.
NAMED_TERMS = [
    "Moodle", "Wellbeing", "IT Services", "Student Finance", "Student Services",
    "UCAS", "DSA", "VLE", "Mount Pleasant", "Townhill", "Clearing",
    "Additional Learning Support", "Careers", "Disabled Students Allowance", "Programme Manager", "personal tutor",
]
QUALIFIER_TERMS = [
    "SA1", "Carmarthen", "Lampeter", "Swansea", "Cardiff", "Birmingham", "London",
    "Nursing", "nursing", "Engineering", "engineering", "Business", "business",
    "Psychology", "psychology", "Art and Design", "art and design",
    "Applied Computing", "Computing", "computing", "Education", "education",
    "Law", "law", "Architecture", "architecture", "Film", "film", "Acting", "acting",
    "Performing Arts", "Games Design", "Games Art", "Animation", "animation",
    "Cyber Security", "Computer Science", "Sport", "sport", "Tourism", "tourism",
    "Marketing", "marketing", "Accounting", "accounting", "Finance", "finance",
    "Health", "health", "Social Work", "social work", "Counselling", "counselling",
    "Teacher Training", "PGCE", "MBA", "PhD", "masters", "Masters",
    "accommodation", "postgraduate", "undergraduate", "tuition", "scholarship",
    "bursary", "halls", "fees", "dissertation", "assignment", "coursework",
    "deadline", "deadlines", "timetable", "timetables", "library", "libraries",
    "wifi", "printing", "parking", "bus", "transport", "shuttle", "enrolment",
    "enrollment", "graduation", "open day", "clearing", "visa", "placement",
    "internship", "exam", "exams", "revision", "results", "transcript", "diploma",
    "references", "reference", "application", "apply", "offer", "interview",
]
TITLE_PHRASE = r"\b([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+){0,2})\b"
CLARIFY_REPLY = [
    r"(could you be (a bit )?more specific|can you (please )?clarify|allech chi fod (ychydig )?yn fwy penodol|allwch chi egluro)",
    r"^(sorry[ ,—-]+)?(could|can) you",
    r"^(mae'?n ddrwg gen i[ ,—-]+)?(allech|allwch)",
]
# Dialogue acts, whole-utterance patterns, first family wins.
DIALOGUE_ACTS = [
    ("clarify", [
        r"what\??", r"huh\??", r"pardon( me)?\??", r"sorry\??", r"(i )?beg your pardon\??", r"come again\??",
        r"(could|can|would) you repeat( that| it)?( please)?\??", r"(could|can) you (say|repeat) that again\??",
        r"(i )?don'?t (quite )?understand\.?", r"(i'?m )?not sure (i )?(understand|follow)\.?",
        r"what do you mean\??", r"what are you (saying|talking about)\??", r"(i'?m )?confused\.?",
        r"say (that )?again( please)?\??", r"didn'?t (quite )?catch (that|you)\.?", r"eh\??", r"mm\??", r"hmm\??",
    ]),
    ("acknowledge", [
        r"ok(ay)?\.?!?", r"alright\.?!?", r"cool\.?!?", r"nice\.?!?", r"(sounds )?good\.?!?", r"great\.?!?",
        r"fine\.?!?", r"got it\.?!?", r"gotcha\.?!?", r"understood\.?!?", r"noted\.?!?", r"i see\.?!?",
        r"makes sense\.?!?", r"that makes sense\.?!?", r"fair enough\.?!?", r"right\.?!?",
        r"(all )?right then\.?!?", r"sure(,? thanks)?\.?!?", r"perfect\.?!?", r"awesome\.?!?",
    ]),
    ("ask_more", [
        r"(please )?(tell|say) me more( about (it|that))?\.?!?\??", r"more (please|details|info|information)?\.?!?\??",
        r"(go on|keep going|continue)\.?!?\??", r"(and|so|well|then)\??", r"anything else\??", r"what else\??",
        r"(can you )?elaborate( on (this|that))?\??", r"expand on (this|that)\??",
        r"(please )?explain( (more|further|it))?\??",
    ]),
    ("yes_no", [
        r"yes\.?!?", r"yes please\.?!?", r"yeah\.?!?", r"yep\.?!?", r"yup\.?!?",
        r"(yes,? )?(of course|certainly|definitely|absolutely)\.?!?", r"sure( thing)?\.?!?", r"no\.?!?",
        r"no thanks\.?!?", r"nope\.?!?", r"nah\.?!?", r"(not )?really\.?!?", r"i don'?t think so\.?!?",
    ]),
]
# Seed utterances of every act, English then Welsh.
SEED_PHRASES = [
    ("clarify", [
        "what", "huh", "sorry", "pardon", "pardon me", "what do you mean",
        "i dont understand", "come again", "say that again",
        "repeat that", "repeat please", "could you repeat",
        "didnt catch that", "im confused", "not sure i follow",
        "beth", "sori", "mae'n ddrwg gennyf", "beth ydych chin ei feddwl",
        "ailadroddwch", "dydw i ddim yn deall", "dwin drysu",
    ]),
    ("acknowledge", [
        "ok", "okay", "alright", "cool", "nice", "sounds good",
        "got it", "gotcha", "understood", "noted", "i see",
        "makes sense", "fair enough", "right", "perfect", "awesome",
        "iawn", "ocê", "wrth gwrs", "deallaf", "da iawn",
    ]),
    ("ask_more", [
        "tell me more", "more", "more please", "more info",
        "go on", "keep going", "continue", "anything else",
        "what else", "elaborate", "explain",
        "mwy", "mwy os gwelwch yn dda", "parhau", "ymhelaethu",
        "dywedwch fwy", "beth arall",
    ]),
    ("yes_no", [
        "yes", "yes please", "yeah", "yep", "yup", "of course",
        "certainly", "definitely", "absolutely", "sure",
        "no", "no thanks", "nope", "nah", "not really",
        "ydw", "ie", "wrth gwrs", "na", "nac ydw", "dim diolch",
    ]),
]

# --------------------------------------------------------------------- safety
# Passage filter.
PASSAGE_INJECTION = [
    r"ignore\s+(all\s+|the\s+|any\s+)?(previous|prior|above|earlier)\s+(instructions?|prompts?|rules?|messages?|directives?)",
    r"disregard\s+(all\s+|the\s+)?(previous|prior|above)\s+(instructions?|prompts?|rules?)",
    r"you\s+are\s+now\s+(a\s+|an\s+)?[a-z\s]{2,40}(instead|not)",
    r"forget\s+(everything|all)\s+(above|before|prior|previous)",
    r"new\s+instructions?\s*:\s*",
    r"(system|admin|developer)\s*(prompt|message|override)\s*[:=]",
    r"\[\s*(system|admin|override|jailbreak)\s*\]",
    r"output\s+only\s+(the\s+following|exactly|this)",
    "respond\\s+only\\s+with\\s+[\"'`]",
    r"print\s+your\s+(system\s+)?prompt",
    r"repeat\s+the\s+(above|following)\s+text",
]
# Message filter, always applied.
MESSAGE_INJECTION = [
    r"\b(system\s+prompt|your\s+(full|complete|entire)\s+(prompt|instructions))\b",
    r"\b(reveal|share|show|tell\s+me|print|output|display)\s+(your|the)\s+(prompt|instructions|system)\b",
    r"\b(ignore|disregard|forget)\s+(all|previous|prior)\s+(instructions|rules|prompts)\b",
    r"\b(you\s+are\s+now|act\s+as|pretend\s+to\s+be)\s+(dan|do\s+anything\s+now)\b",
    r"\b(jailbreak|developer\s+mode|admin\s+mode|god\s+mode)\b",
    r"\b(grandmother|grandma|mum|mother|nan)\s+(used\s+to\s+)?(read|tell|recite|sing)\s+me\b",
    r"previous\s+instruction\s+(has\s+been|is)\s+(cancelled|canceled|revoked|overridden)",
    r"\b(pretend|act|behave|simulate|roleplay)\s+(as|to\s+be|that\s+you\s+are)\s+(a\s+|an\s+)?(python|javascript|node|bash|shell|interpreter|compiler)\b",
    r"\bexecute\s+(this|the\s+following|this\s+code|the\s+code)\b",
    "\\bopen\\s*\\(\\s*['\"][^'\"]+\\.(txt|py|js|json|env|conf)['\"]",
    r"\b(write|generate|give\s+me|create|build|make)\s+(a\s+|an\s+|me\s+)?(python|javascript|bash|shell|node)\s+(script|code|program|tool|function)\b.*\b(scrap|crawl|harvest|extract|download)\b",
    r"\b(scrap(e|ing|er)?|crawl(ing|er)?)\s+(twitter|x\.com|linkedin|instagram|facebook|reddit|tiktok|youtube|google)\b",
    r"\b(brute\s+force|password\s+crack|sql\s+injection|xss\s+payload|csrf\s+exploit|0day|zero\s+day)\b",
]
# Message filter, Welsh turns only.
MESSAGE_INJECTION_CY = [
    r"anwybyddwch.*(cyfarwyddiadau|rheolau|prompt)",
    r"(dangoswch|rhannwch|datgelwch).*(prompt|cyfarwyddiadau|system)",
    r"esgus.*(ieithydd|honglydd|python|shell|bash)",
    r"\b(sgrap|crawl)\w*\s+(twitter|x\.com|facebook|instagram)",
]
# Personal data shapes.
PII_NI = r"\b[A-CEGHJ-PR-TW-Z]{2}\s?\d{2}\s?\d{2}\s?\d{2}\s?[A-D]\b"
PII_CARD = r"\b(?:\d[ -]?){13,19}\b"
PII_EMAIL = r"\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PII_PHONE = r"\b(?:\+?44\s?)?(?:0\s?)?(?:\d[\s\-]?){10,11}\b"
PII_STUDENT = r"\b(?:student\s*id[:\s]*)(\d{7,9})\b"
PII_POSTCODE = r"\b[A-Z]{1,2}\d{1,2}[A-Z]?\s*\d[A-Z]{2}\b"
# Parenthetical clean-up.
PAREN_KEEP = ["er enghraifft", "e.e.", "h.y.", "sef", "neu'n", "neu", "gweler", "cyfeiriad", "cofiwch"]
PAREN_ENGLISH = (
    "the that this what which there here have has would could should about with your you we "
    "they them their and but for from not any all some when where how why hello hi help "
    "please thanks thank sorry means translated translation"
).split()
PAREN_WELSH = (
    "mae yw ydy ydw dw dwi rydw yr chi ti sut beth pam pryd ble shwmae helo diolch croeso "
    "prifysgol myfyriwr cymraeg cymru"
).split()

# ------------------------------------------------------------------------- web
# Links never followed.
URL_SKIP = [
    r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|tar|gz|jpg|jpeg|png|gif|svg|mp4|mp3|avi|mov|wmv|ico|css|js|woff|woff2|ttf|eot)(\?.*)?$",
    r"#",
    r"mailto:",
    r"tel:",
    r"javascript:",
    r"/wp-admin",
    r"/wp-login",
    r"\?.*print=",
    r"\?.*replytocom=",
]
SKIPPED_TAGS = ["script", "style", "nav", "footer", "header", "noscript", "iframe", "form"]

# ------------------------------------------------------------------- retrieval
# Fixed values.
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K = 60
TFIDF_FLOOR = 0.05
TOPIC_FLOOR = 0.12
FACT_FLOOR = 0.28
INTENT_FLOOR, INTENT_CLARIFY = 0.07, 0.20
FUZZY_FLOOR = 45.0
CHUNK_SIZE, CHUNK_OVERLAP = 500, 80
CHUNK_SEPARATORS = ["\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", ""]
AUDIT_QUALIFIERS = "international postgraduate undergraduate home online parttime phd pgce".split()

# Paraphrase templates.
TEMPLATES_EN = [
    "how do I {X}", "how can I {X}", "where do I {X}", "where can I {X}",
    "what is {X}", "what's {X}", "tell me about {X}", "info on {X}",
    "information about {X}", "help with {X}", "i need help with {X}",
    "what about {X}", "any info on {X}", "explain {X}",
    "can you tell me about {X}", "show me {X}", "i want to know about {X}", "{X} please", "{X}?",
]
TEMPLATES_CY = [
    "sut wyf i'n {X}", "sut alla i {X}", "ble ydw i'n {X}", "beth yw {X}", "beth am {X}",
    "dywedwch wrtha i am {X}", "gwybodaeth am {X}", "help gyda {X}", "eglurwch {X}",
    "{X} os gwelwch yn dda", "{X}?",
]
