"""Digests of entire licences by canonical text, with and without titles, appendices and closing lines."""

#: Digest of the canonical text (see licenses.digest) and name.
DIGESTS = {
    "0761f5da3157131a4066c64d0f78f8e8f99e95278badc18f8cc86843f7b265fd": "Apache-2.0",
    "873edd0ccc3c01e411165b4720bfc392606066b9bec0176c09da5b0612730f65": "Apache-2.0",
    "b813a1954057bcf67fbd77bd4d0e2a615bacca9f2d19982a4f64e981cd46f540": "Apache-2.0",
    "126495a1a84801bd61a644e3ba3de92ad3922e6820d02d88be6acf0ff4438ed6": "Artistic-1.0",
    "957c3854a3d72e069e7f5e48857ad9ab76135f14c70d60fa9ec6ef9a928d45dd": "BSD-2-Clause",
    "986c3c3199a93b916c8f2e0aeed57819bcbdcb2cd9d99902dcc9d74b53f93a74": "BSD-2-Clause",
    "eda2ad636e738f6a26a2fea902bb734ee48c789a5b40035b8db3659bd951e5bc": "BSD-2-Clause",
    "007fde9b266f35183b511c8c01994581175bfdaa48438967e905c31fb50ba523": "BSD-3-Clause",
    "0fd715971b9eef40682d457e9b18f9eb0bdde1b640847b28593e4094f8871915": "BSD-3-Clause",
    "1238550805feaeec7ac6f60c2a1b7b3828c3fb1e9d9d52c718c3b75c7b5ff98e": "BSD-3-Clause",
    "9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2": "BSD-3-Clause",
    "cc65957a28f15bbcef5b0c23770aae3bd8462cb25904250f77a812ab3b2efe15": "BSD-3-Clause",
    "cf77ee3d20f4076cecdb58fc53aa7204c9f5c0651621abbc85e028f5b2ffa6b4": "BSD-3-Clause",
    "eabe215ff5a2cf5b1c090915b7cabdf511f70fc79fb8fde85247ebe3038a9658": "BSD-3-Clause",
    "3d151449461c0c776e892a4dc41cac0d251eb00c9fc49d2d48802d9bed818fe9": "BSD-3-Clause (Regents)",
    "a3dd88523d064729624e3bb2ddc415676a7558ed33ab9ce6ba9fa82627a15a8d": "CC0-1.0",
    "f8afe2875e6497e47d6968e78b9e54fdcda585535e3d64d6afe7674926caccaf": "GFDL-1.2",
    "89fec678dd005185c9556d6ae27cfdb0a41c24e6701e07e6c554c42ae4980983": "GFDL-1.3",
    "1852a6de213e6f0371331f917efeb820703680ad510a8ba17df7d5f5f36048a8": "GPL-1.0",
    "89fffaecf09d24f5c2f528446ca90a6df4a138c528ab29d7d53383c757303146": "GPL-1.0",
    "eb13d7c8692eddf95574d4c10224664d9524d70b1ee73cc706b60b31fa186712": "GPL-1.0",
    "0d5d05ca2402c760170d172c43e35bb6e8038195148215d470f5f1c1b284aacd": "GPL-2.0",
    "3fb7fc82902884abcd3fe6d13615877250a4d39720855ef60906ac4e534b1dd4": "GPL-2.0",
    "c8ca44b36f3c3c3b02784824caa0a1aae7b13da63497e8b3a0688093eebd6046": "GPL-2.0",
    "22ed0d42934ed5f731135a6e666d38611f47632a1c71a00446f4b5538e665107": "GPL-3.0",
    "95c833fee27a59e94eafb784677a31f381226dcb91d9407915d8b9559dc40bda": "GPL-3.0",
    "f86ac9e5ff19aabaf1f4b6b73599947c9c07dfa29057d287cde720f7241b40e3": "GPL-3.0",
    "86fe7eb6f4d5e70c696fa8587aa17993b9a1d57499d69f4c43e3a97b766f99f5": "LGPL-2.0",
    "b31fc6b481adde06a87c4e154bf32ea2fb36bad174410f3dfcaa697cc2a2f890": "LGPL-2.0",
    "de3fe212f982f228da29da589e2bca23f7d1cf9382c51b998c5e6ab8868827ae": "LGPL-2.0",
    "a6907e9bcbdbb867404186215773a3fb0d0151d0090ec159f735cb8700979d44": "LGPL-2.1",
    "b26797618d785e06770f71438917d8bcd1cef7cc3428cb5c765b5c2057263a6e": "LGPL-2.1",
    "c5c12bf17c070c774b1c114a5dda5df4e1f0e12c7204e193bc1c37b5894f01ca": "LGPL-2.1",
    "3ede7494a82fe6f9c1d0a28646ae309d51b9cc301b39d60d0de3be5c1869bd38": "LGPL-3.0",
    "2c562a512277cc4e6b40222a77da8b753af18faf616f13842c25dc176a6f1674": "MIT",
    "5a61e6269f207d1859b7c1a274cce5485f26aa69e567a5a0b48c8321413881e6": "MIT",
    "6b32b7b2134c7fcb2d244ac6e4fe70d2eaacd0aaaef0cdea349fa0ee67111fde": "MIT",
    "df7076f047c7a3992cbee5397176bbcc895de8ea6a2ae3a2c6e3e688e74fd9b2": "MPL-1.1",
    "337e493975eeb4f3c7097a25848f071b472ebbc1e4e9f950e4b985ee4d0aa17a": "MPL-2.0",
    "564f11bfa71695a159d81c326063ca18ef4ebb493a9bb94c89f93d4bb72224c7": "Zlib",
    "7f26f8b90276afd0048d63bad47435af2f8acd63e6df6cc3dee24fde250974e5": "Zlib",
}
