"""The behaviour rules behind the checkers, and what each checker looks for."""

from __future__ import annotations

from .operators.rules import Call, Checker

# ---------------------------------------------------------------------------------------
# Rules as (crime, first call, second call), each call (class, method, descriptor).
# ---------------------------------------------------------------------------------------
RULES = {
    "accessFileInExternalDir": (
        "Access a file in an external directory",
        ("Landroid/os/Environment;", "getExternalStorageDirectory", "()Ljava/io/File;"),
        ("Ljava/io/File;", "<init>", "(Ljava/io/File;Ljava/lang/String;)V"),
    ),
    "checkFileExistence": (
        "Check file existence",
        ("Ljava/io/File;", "<init>", "(Ljava/lang/String;)V"),
        ("Ljava/io/File;", "exists", "()Z"),
    ),
    "configureJsExecution": (
        "Configure JavaScript execution on websites",
        ("Landroid/webkit/WebView;", "getSettings", "()Landroid/webkit/WebSettings;"),
        ("Landroid/webkit/WebSettings;", "setJavaScriptEnabled", "(Z)V"),
    ),
    "deserializeData": (
        "Deserialize Data",
        ("Ljava/io/ObjectInputStream;", "<init>", "(Ljava/io/InputStream;)V"),
        ("Ljava/io/ObjectInputStream;", "readObject", "()Ljava/lang/Object;"),
    ),
    "executeSQLCommand": (
        "Execute SQL Command",
        ("Ljava/lang/StringBuilder;", "append", "(Ljava/lang/String;)Ljava/lang/StringBuilder;"),
        (
            "Landroid/database/sqlite/SQLiteDatabase;",
            "rawQuery",
            "(Ljava/lang/String; [Ljava/lang/String;)Landroid/database/Cursor;",
        ),
    ),
    "externalStringCommand": (
        "Using external strings as commands",
        ("Landroid/content/Intent;", "getStringExtra", "(Ljava/lang/String;)Ljava/lang/String"),
        ("Ljava/lang/Runtime;", "exec", "(Ljava/lang/String;)Ljava/lang/Process"),
    ),
    "loadExternalCode": (
        "Load external code from other APK.",
        ("", "createPackageContext", "(Ljava/lang/String;I)Landroid/content/Context;"),
        ("Ljava/lang/ClassLoader;", "loadClass", "(Ljava/lang/String;)Ljava/lang/Class;"),
    ),
    "loadUrlFromIntent": (
        "Load Url from Intent and open WebView",
        ("Landroid/content/Intent;", "getStringExtra", "(Ljava/lang/String;)Ljava/lang/String"),
        ("Landroid/webkit/WebView;", "loadUrl", "(Ljava/lang/String;)V"),
    ),
    "loadUrlFromIntent2": (
        "Load URL from intent to WebView",
        ("Landroid/content/Intent;", "getData", "()Landroid/net/Uri;"),
        ("Landroid/webkit/WebView;", "loadUrl", "(Ljava/lang/String;)V"),
    ),
    "openUrlThatUserInput": (
        "Open the Url that user input",
        ("Landroid/widget/EditText;", "getText", "()Landroid/text/Editable;"),
        ("Landroid/webkit/WebView;", "loadUrl", "(Ljava/lang/String;)V"),
    ),
    "setRetrofitBaseUrl": (
        "Set Retrofit Base Url",
        ("Lretrofit2/Retrofit$Builder;", "<init>", "()V"),
        ("Lretrofit2/Retrofit$Builder;", "baseUrl", "(Ljava/lang/String;)Lretrofit2/Retrofit$Builder;"),
    ),
    "useMethodOfPRNG": (
        "Use method of PRNG",
        ("Ljava/util/Random;", "<init>", "()V"),
        ("Ljava/util/Random;", "nextInt", "(I)I"),
    ),
    "useOfCryptographicAlgo": (
        "Use of cryptographic algorithm",
        ("Ljavax/crypto/Cipher;", "getInstance", "(Ljava/lang/String; Ljava/lang/String;)Ljavax/crypto/Cipher"),
        ("Ljavax/crypto/Cipher;", "init", "(I Ljava/security/Key;)V"),
    ),
    "writeContentToLog": (
        "Write contents to the log.",
        (
            "Lcom/google/android/material/textfield/TextInputEditText;",
            "getText",
            "()Landroid/text/Editable;",
        ),
        ("Landroid/util/Log;", "d", "(Ljava/lang/String;Ljava/lang/String;)I"),
    ),
}
RULE_SCORE = 1.0

# ---------------------------------------------------------------------------------------
# Methods and words the checkers know.
# ---------------------------------------------------------------------------------------
VALIDATING_METHODS = ["contains", "indexOf", "matches", "replaceAll"]
STRING_MATCHING_CALLS = [
    ("Ljava/lang/String;", "contains", "(Ljava/lang/CharSequence)Z"),
    ("Ljava/lang/String;", "indexOf", "(I)I"),
    ("Ljava/lang/String;", "indexOf", "(Ljava/lang/String;)I"),
    ("Ljava/lang/String;", "matches", "(Ljava/lang/String;)Z"),
]
XSS_FILTER_CALLS = [
    (
        "Lorg/owasp/esapi/Validator;",
        "getValidSafeHTML",
        "(Ljava/lang/String; Ljava/lang/String; I Z)Ljava/lang/String;",
    ),
    ("Lorg/owasp/esapi/Encoder;", "encodeForHTML", "(Ljava/lang/String;)Ljava/lang/String;"),
    ("Lorg/owasp/esapi/Encoder;", "encodeForJavaScript", "(Ljava/lang/String;)Ljava/lang/String;"),
    ("Lorg/owasp/html/PolicyFactory;", "sanitize", "(Ljava/lang/String;)Ljava/lang/String;"),
]
SIGNATURE_CHECK = (
    "Landroid/content/pm/PackageManager;",
    "checkSignatures",
    "(Ljava/lang/String;Ljava/lang/String;)I",
)
FILE_ORIGIN_METHODS = ["exists", "getFilesDir", "getExternalFilesDir", "getExternalStorageDirectory"]
INTENT_METHODS = ["findViewById", "getStringExtra", "getIntent"]
NEUTRALISING_WORDS = ["escape", "replace", "format", "setFilter"]
EXTERNAL_INPUT_WORDS = ["getIntent", "getQueryParameter"]
INPUT_FILTER_WORDS = [
    "parse", "isValidUrl", "Pattern", "Matcher", "encode", "decode", "escapeHtml", "HttpURLConnection",
]
CLEARTEXT_PROTOCOLS = ["http", "smtp", "ftp"]
WEAK_CIPHERS = ["DES", "ARC4", "BLOWFISH"]
WEAK_HASHES = ["MD2", "MD4", "MD5", "PANAMA", "SHA0", "SHA1", "HAVAL128", "RIPEMD128"]
CREDENTIAL_LOG_WORDS = ["token", "decrypt", "password"]
CREDENTIAL_NAME_WORDS = [
    "token", "password", "account", "encrypt", "authentication", "authorization", "id", "key",
]
COMMAND_SPECIALS = "[ ;|,>`]+"
SSL_PROCEED = ("Landroid/webkit/SslErrorHandler;", "proceed", "()V")
SSL_OVERRIDE = (
    "Landroid/webkit/WebViewClient;",
    "onReceivedSslError",
    "(Landroid/webkit/WebView; Landroid/webkit/SslErrorHandler; Landroid/net/http/SslError;)V",
)

LITERAL = '^"'  # string constants in argument lists stand in double quotes
SWITCHED_ON = "^(?!0$|false$).+"


def _call(parts, **conditions) -> Call:
    return Call(*parts, **conditions)


def _rule(name: str, checker: str, first: dict | None = None, target: dict | None = None, **conditions) -> Checker:
    _, first_call, second_call = RULES[name]
    return Checker(
        checker, _call(second_call, **(target or {})), first=_call(first_call, **(first or {})), **conditions
    )


def _spelled(words) -> str:
    """A pattern for any of the words, with dashes allowed between their characters."""
    return "|".join("-*".join(word) for word in words)


CHECKERS = [
    _rule("openUrlThatUserInput", "CWE20", arg_method_not_in=VALIDATING_METHODS),
    _rule(
        "accessFileInExternalDir", "CWE22", min_args=3, arg_position=2, arg_lacks=LITERAL,
        mitigations=[_call(c) for c in STRING_MATCHING_CALLS],
    ),
    _rule("accessFileInExternalDir", "CWE23", min_args=3, arg_position=2, arg_lacks=LITERAL),
    _rule("externalStringCommand", "CWE78", excused_by=VALIDATING_METHODS, excuse_void=COMMAND_SPECIALS),
    _rule(
        "loadUrlFromIntent2", "CWE79",
        needs=[_call(RULES["configureJsExecution"][2], arg_position=1, arg_pattern=SWITCHED_ON)],
        mitigations=[_call(c) for c in XSS_FILTER_CALLS],
    ),
    _rule("externalStringCommand", "CWE88", excused_by=VALIDATING_METHODS, excuse_void="-"),
    _rule("executeSQLCommand", "CWE89", arg_method_in=["getText"]),
    _rule("loadExternalCode", "CWE94", mitigations=[_call(SIGNATURE_CHECK)]),
    _rule("writeContentToLog", "CWE117", min_args=2, arg_position=1, arg_lacks="|".join(NEUTRALISING_WORDS)),
    _rule(
        "setRetrofitBaseUrl", "CWE319",
        target={"arg_pattern": f"({'|'.join(CLEARTEXT_PROTOCOLS)})://[0-9A-Za-z./-]+"},
    ),
    _rule("useOfCryptographicAlgo", "CWE327", first={"arg_pattern": "|".join(WEAK_CIPHERS)}),
    Checker(
        "CWE328",
        Call(
            "Ljava/security/MessageDigest;", "getInstance", "(Ljava/lang/String;)Ljava/security/MessageDigest;",
            arg_pattern=_spelled(WEAK_HASHES), arg_position=0,
        ),
    ),
    Checker(
        "CWE328",
        Call(
            "Ljavax/crypto/SecretKeyFactory;", "getInstance",
            "(Ljava/lang/String;)Ljavax/crypto/SecretKeyFactory;",
            arg_pattern=_spelled(WEAK_HASHES), arg_position=0,
        ),
    ),
    _rule("deserializeData", "CWE502", arg_method_not_in=FILE_ORIGIN_METHODS),
    Checker(
        "CWE532",
        Call(
            "Landroid/util/Log;", "d", "(Ljava/lang/String; Ljava/lang/String;)I",
            arg_pattern="|".join(CREDENTIAL_LOG_WORDS), arg_position=1,
        ),
    ),
    Checker(
        "CWE601",
        Call(
            "", "startActivity", "(Landroid/content/Intent;)V",
            arg_pattern=f"(?s)^(?!.*({'|'.join(INPUT_FILTER_WORDS)})).*({'|'.join(EXTERNAL_INPUT_WORDS)})",
        ),
    ),
    _rule(
        "configureJsExecution", "CWE749", target={"arg_position": 1, "arg_pattern": SWITCHED_ON},
        needs=[
            Call(
                "Landroid/webkit/WebView;", "addJavascriptInterface", "(Ljava/lang/Object; Ljava/lang/String;)V"
            )
        ],
    ),
    _rule("useOfCryptographicAlgo", "CWE780", first={"arg_pattern": "(?s)^(?!.*OAEP).*RSA"}),
    Checker(
        "CWE798",
        Call("Ljavax/crypto/spec/SecretKeySpec;", "<init>", arg_pattern="^\"?AES\"?$", arg_position=2),
        arg_position=1, arg_lacks='^[^"]',
    ),
    _rule("checkFileExistence", "CWE921", target={"arg_pattern": "sdcard", "arg_position": 0}),
    _rule("loadUrlFromIntent", "CWE940", arg_methods_only=INTENT_METHODS),
    _rule(
        "accessFileInExternalDir", "CWE73", min_args=3, arg_position=2, arg_lacks=LITERAL, enabled=False,
        needs=[
            Call(
                "Landroid/os/ParcelFileDescriptor;", "open",
                "(Ljava/io/File; I)Landroid/os/ParcelFileDescriptor;",
            )
        ],
    ),
]


def rule_rows():
    """The rules as rows of the rule table."""
    return [
        (
            crime,
            [],
            [{"class": c, "method": m, "descriptor": d} for c, m, d in (first, second)],
            RULE_SCORE,
            [],
        )
        for crime, first, second in RULES.values()
    ]
