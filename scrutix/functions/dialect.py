r"""Regular expressions in the Java dialect that match what Python's would.

``\w`` is ``[\p{L}\p{N}_]``, ``(?d)`` keeps line ends to ``\n``, ``(?iu)``
ignores case beyond ASCII and ``\s`` is spelled with the separators Python
knows.
"""

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"
S = r"[\s\x1c-\x1f\x85\p{Z}]"
NS = r"[^\s\x1c-\x1f\x85\p{Z}]"
B0 = rf"(?<!{W})"  # a word boundary before a word character
B1 = rf"(?!{W})"  # one after a word character
B = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"

# --- fixed values: the patterns' meaning -------------------------------------

WORD = rf"{W}(?:[\p{{L}}\p{{N}}_'\-]*{W})?"
SENTENCE_END = r"[.!?]+"
LINK = rf"(?iu)https?://{NS}+|www\.{NS}+"
NUMBER = rf"(?iu)(?<!{W})\p{{Nd}}+(?:[.,:/\-]\p{{Nd}}+)*(?:%|x|ms|s|m|h|kb|mb|gb|tb)?(?:{B}|(?=%))"
CITATION = rf"(?iu)\[\p{{Nd}}+(?:[\s\x1c-\x1f\x85\p{{Z}},\-]\p{{Nd}}+)*\]|\([A-Z][A-Za-z .\-]+,{S}*\p{{Nd}}{{4}}\)|{B}doi:{S}*{NS}+|{B}10\.\p{{Nd}}{{4,9}}/{NS}+"
CITATION_HINT = r"(?iu)\[\p{Nd}|\(\p{L}|doi:|10\.\p{Nd}"
NOT_ONLY = (
    rf"(?iu){B}(?:it'?s|that'?s|this is|we'?re|they'?re|you'?re)?{S}*not{S}+(?:just|only|merely|simply){B}[^.!?]{{1,80}}?"
    rf"(?:,{S}*(?:it'?s|it{S}+is|that'?s|that{S}+is|but rather|but){B}|{S}-{S}|;{S}*(?:it'?s|it{S}+is){B})"
)
NOT_DASH = rf"(?iu){B}not{S}+[^.!?,]{{2,40}}{S}*-{S}*(?:it'?s|but|rather){B}"
TRIAD = rf"(?iu)(?<!{W})({W}++(?:{S}{W}++){{0,2}}),{S}+({W}++(?:{S}{W}++){{0,2}}),{S}+(?:and|or){S}+({W}++(?:{S}{W}++){{0,2}})"
MD_HEADER = rf"(?md)^{S}{{0,3}}#{{1,6}}{S}+{NS}"
MD_BOLD = r"\*\*[^*\n]{1,60}\*\*"
EMOJI_BULLET = rf"(?md)^{S}*(?:[-*]{S}+)?(?:✅|❌|✨|•|\x{{1F449}}|\x{{1F539}}|\x{{1F4A1}}|\x{{1F680}}|➡|⭐)"
#: Kinds of concrete detail, each behind a cheap hint without which it cannot occur.
SPECIFIC = {
    "ip": (r"\p{Nd}\.\p{Nd}", rf"{B}\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}\.\p{{Nd}}{{1,3}}{B}"),
    "ipv6": (r"[0-9a-fA-F]:[0-9a-fA-F]{1,4}:", rf"(?iu){B}(?:[0-9a-f]{{1,4}}:){{2,7}}[0-9a-f]{{1,4}}{B}"),
    "port": (r"(?iu)(?:port|tcp|udp)", rf"(?iu){B}(?:port|tcp|udp){S}*[:#]?{S}*\p{{Nd}}{{1,5}}{B}"),
    "cve": (r"(?iu)CVE-", rf"(?iu){B}CVE-\p{{Nd}}{{4}}-\p{{Nd}}{{4,7}}{B}"),
    "hash": (r"[0-9a-fA-F]{40}", rf"(?iu){B}[0-9a-f]{{40}}{B}|{B}[0-9a-f]{{64}}{B}"),
    "date": (r"\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}", rf"{B}(?:19|20)\p{{Nd}}{{2}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}{B}|{B}\p{{Nd}}{{4}}-\p{{Nd}}{{2}}-\p{{Nd}}{{2}}T\p{{Nd}}{{2}}:\p{{Nd}}{{2}}"),
    "domain": (r"(?iu)\.(?:com|org|net|io|ai|dev|gov|edu|uk|de|fr|jp|cn|au|ca)", rf"(?iu){B}[a-z0-9][a-z0-9\-]+\.(?:com|org|net|io|ai|dev|gov|edu|uk|de|fr|jp|cn|au|ca){B}"),
    "url": (r"https?://", rf"https?://{NS}+"),
    "file_path": (r"[/\\]", rf"(?:^|{S})/[\p{{L}}\p{{N}}_\-./]+|{B}[A-Za-z]:\\[\p{{L}}\p{{N}}_\-\\.]+"),
    "version": (r"\p{Nd}\.\p{Nd}", rf"{B}v?\p{{Nd}}+\.\p{{Nd}}+(?:\.\p{{Nd}}+){{0,2}}{B}"),
    "ticket": (r"[A-Z]-\p{Nd}{3}|#\p{Nd}{3}", rf"{B}[A-Z]{{2,8}}-\p{{Nd}}{{3,6}}{B}|{B}#\p{{Nd}}{{3,6}}{B}"),
    "measurement": (rf"(?iu)\p{{Nd}}{S}*[mshdgtk%]", rf"(?iu){B}\p{{Nd}}+(?:\.\p{{Nd}}+)?{S}*(?:ms|s|min|h|hour|hours|day|days|MB|GB|TB|KB|kbps|mbps|gbps|%){B}"),
}
EVIDENCE = (
    rf"{B}\p{{Nd}}|https?://|CVE-\p{{Nd}}{{4}}-\p{{Nd}}|doi:|\[\p{{Nd}}+\]|\([A-Z][a-z]+,{S}*\p{{Nd}}{{4}}\)|"
    rf"{B}[A-Z][a-zA-Z]+(?:{S}[A-Z][a-zA-Z]+)*{S}(?:Inc|LLC|Ltd|Corp|Co|GmbH|University|Institute|Foundation|Labs?|Agency|Department|Commission|Association|Consortium){B}"
)
