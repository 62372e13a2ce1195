"""Word lists and tables that results depend on, in their natural order."""

from __future__ import annotations

# form=base for words that no suffix rule reaches.
IRREGULAR = """
hath=have hast=have has=have had=have hadst=have having=have goes=go goeth=go goest=go doeth=do doest=do
doth=do dost=do does=do did=do didst=do done=do
saith=say said=say saidst=say says=say
spake=speak spoke=speak spoken=speak spakest=speak
art=be wast=be wert=be is=be am=be are=be was=be were=be been=be being=be
shalt=shall wilt=will canst=can couldest=could mayest=may
ran=run came=come went=go gone=go knew=know known=know
gave=give given=give took=take taken=take saw=see seen=see
ate=eat eaten=eat brought=bring taught=teach sought=seek
bought=buy fought=fight caught=catch built=build sent=send
slew=slay slain=slay smote=smite smitten=smite arose=arise
arisen=arise rose=rise risen=rise begat=beget begotten=beget
forgave=forgive forgiven=forgive wrote=write written=write
drank=drink drunk=drink sang=sing sung=sing chose=choose
chosen=choose fell=fall fallen=fall held=hold kept=keep
met=meet sat=sit stood=stand told=tell wept=weep
slept=sleep bare=bear bore=bear born=bear borne=bear
drew=draw drawn=draw grew=grow grown=grow threw=throw
thrown=throw shook=shake shaken=shake forsook=forsake
forsaken=forsake abode=abide strove=strive clave=cleave
trodden=tread trode=tread men=man women=woman children=child
brethren=brother feet=foot teeth=tooth oxen=ox lice=louse
thee=you thou=you ye=you thy=your thine=your
yourselves=yourself got=get gotten=get felt=feel fed=feed
fled=flee led=lead laid=lay lain=lie lay=lay paid=pay
heard=hear made=make found=find stole=steal stolen=steal
rode=ride ridden=ride hid=hide hidden=hide bound=bind
wound=wind ground=ground thought=think lost=lose left=leave
blew=blow flew=fly knelt=kneel dwelt=dwell meant=mean
worn=wear wore=wear tare=tear torn=tear swore=swear
sware=swear sworn=swear began=begin begun=begin overcame=overcome
understood=understand withstood=withstand became=become better=better
"""

# Words that the suffix rules would turn into another word.
KEEP = """
forest rest honest harvest west nest chest guest priest beast feast
least breast jest manifest tempest earnest interest request conquest
behest unrest midst east lest best highest thing nothing something
anything everything spring string evening king wing ring sling bring
sing swing sting ceiling wilderness witness harness seed need speed
creed indeed deed feed bleed breed greed weed reed hundred kindred
sacred naked wicked red bed shed wed led fled
bread head dead lead thread dread tread spread abroad ahead instead
always alas bless less unless guess press dress goodness kindness
seth beth japheth nazareth elisabeth heth teeth lord news this his
was is has us thus jesus moses amos lazarus cyrus darius judas
eves series species gallows bowels riches ashes
"""

# Function words and filler, matched against stems.
STOP = """
a an and as at be but by for from he her him his i if
in into it its me my of on or our so that the their
them then there they this to unto us we which who whom with
you your shall have not upon what when where also do about
something verse vers passage bible say talk mention quote scripture
get will these those nor neither o oh how whose she one some
thing very can could would should may might let go make
"""

# Accented letters and the plain letter each one counts as.
FOLD_FROM = "àáâãäåāăąçćčèéêëēĕėęěìíîïīĭįñńòóôõöōŏőùúûüūŭůýÿṭşšśṣḥẖẓžæ"
FOLD_TO = "aaaaaaaaaccceeeeeeeeeiiiiiiinnoooooooouuuuuuuyytsssshhzza"

# Endings tried in this order.
SUFFIXES = ("edst", "ness", "eth", "est", "ing", "ed", "es", "s")

# Code | name | short name | aliases, in canonical order.
COLLECTIONS = """
GEN|Genesis|Gen|gen ge gn
EXO|Exodus|Exod|exo ex exod
LEV|Leviticus|Lev|lev le lv
NUM|Numbers|Num|num nu nm nb
DEU|Deuteronomy|Deut|deut dt de deu
JOS|Joshua|Josh|josh jos jsh
JDG|Judges|Judg|judg jdg jg jdgs
RUT|Ruth|Ruth|rth ru rut
1SA|1 Samuel|1 Sam|1sam 1sa 1sm 1s
2SA|2 Samuel|2 Sam|2sam 2sa 2sm 2s
1KI|1 Kings|1 Kgs|1kgs 1ki 1kin 1k
2KI|2 Kings|2 Kgs|2kgs 2ki 2kin 2k
1CH|1 Chronicles|1 Chr|1chr 1ch 1chron
2CH|2 Chronicles|2 Chr|2chr 2ch 2chron
EZR|Ezra|Ezra|ezr ez
NEH|Nehemiah|Neh|neh ne
EST|Esther|Esth|esth est es
JOB|Job|Job|jb
PSA|Psalms|Ps|ps psa psalm pslm psm pss
PRO|Proverbs|Prov|prov pro prv pr
ECC|Ecclesiastes|Eccl|eccl ecc ec qoh
SNG|Song of Solomon|Song|song sos ss sng canticles songofsongs
ISA|Isaiah|Isa|isa is
JER|Jeremiah|Jer|jer je jr
LAM|Lamentations|Lam|lam la
EZK|Ezekiel|Ezek|ezek eze ezk
DAN|Daniel|Dan|dan da dn
HOS|Hosea|Hos|hos ho
JOL|Joel|Joel|jl joe jol
AMO|Amos|Amos|amo am
OBA|Obadiah|Obad|obad ob oba
JON|Jonah|Jonah|jon jnh
MIC|Micah|Mic|mic mc
NAM|Nahum|Nah|nah na nam
HAB|Habakkuk|Hab|hab hb
ZEP|Zephaniah|Zeph|zeph zep zp
HAG|Haggai|Hag|hag hg
ZEC|Zechariah|Zech|zech zec zc
MAL|Malachi|Mal|mal ml
MAT|Matthew|Matt|matt mt mat
MRK|Mark|Mark|mrk mk mr
LUK|Luke|Luke|luk lk
JHN|John|John|jn jhn joh
ACT|Acts|Acts|act ac
ROM|Romans|Rom|rom ro rm
1CO|1 Corinthians|1 Cor|1cor 1co
2CO|2 Corinthians|2 Cor|2cor 2co
GAL|Galatians|Gal|gal ga
EPH|Ephesians|Eph|eph ephes
PHP|Philippians|Phil|phil php pp
COL|Colossians|Col|col
1TH|1 Thessalonians|1 Thess|1thess 1th 1thes
2TH|2 Thessalonians|2 Thess|2thess 2th 2thes
1TI|1 Timothy|1 Tim|1tim 1ti
2TI|2 Timothy|2 Tim|2tim 2ti
TIT|Titus|Titus|tit ti
PHM|Philemon|Phlm|philem phm pm
HEB|Hebrews|Heb|heb
JAS|James|Jas|jas jm jam
1PE|1 Peter|1 Pet|1pet 1pe 1pt 1p
2PE|2 Peter|2 Pet|2pet 2pe 2pt 2p
1JN|1 John|1 John|1jn 1jo 1jhn
2JN|2 John|2 John|2jn 2jo 2jhn
3JN|3 John|3 John|3jn 3jo 3jhn
JUD|Jude|Jude|jud jd
REV|Revelation|Rev|rev re rv revelations
"""

# Scope name = first and last collection of its range.
SCOPES = """
ot=GEN-MAL old=GEN-MAL
nt=MAT-REV new=MAT-REV
law=GEN-DEU torah=GEN-DEU pentateuch=GEN-DEU
history=JOS-EST
poetry=JOB-SNG wisdom=JOB-SNG
prophets=ISA-MAL
major=ISA-DAN
minor=HOS-MAL
gospels=MAT-JHN gospel=MAT-JHN
epistles=ROM-JUD letters=ROM-JUD
paul=ROM-PHM pauline=ROM-PHM
general=HEB-JUD
"""

IRREGULAR_FORMS: dict[str, str] = dict(pair.split("=") for pair in IRREGULAR.split())
KEEP_WORDS: list[str] = KEEP.split()
STOP_STEMS: list[str] = STOP.split()
