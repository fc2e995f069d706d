"""The rules that come with the extractors."""

from __future__ import annotations

# Name, module ("" where the type alone is known), graph, types and mime patterns; the first rule by name counts.
RULES = [
    ("10-abw.rule", "abw", "Documents", "nfo:Document", "application/x-abiword"),
    ("10-bmp.rule", "bmp", "Pictures", "nfo:Image nmm:Photo", "image/bmp"),
    ("10-comics.rule", "", "Documents", "nfo:EBook", "application/x-cbr application/x-cbz application/x-cbt application/x-cb7 application/vnd.comicbook+zip"),
    ("10-desktop.rule", "desktop", "Software", "nfo:SoftwareApplication", "application/x-desktop"),
    ("10-ebooks.rule", "", "Documents", "nfo:EBook nfo:PaginatedTextDocument", "application/x-zip-compressed-fb2 application/x-fictionbook+xml application/x-mobipocket-ebook image/vnd.djvu+multipage"),
    ("10-epub.rule", "epub", "Documents", "nfo:EBook nfo:TextDocument", "application/epub+zip"),
    ("10-folder.rule", "", "", "nfo:Folder", "inode/directory"),
    ("10-gif.rule", "gif", "Pictures", "nfo:Image nmm:Photo", "image/gif"),
    ("10-html.rule", "html", "Documents", "nfo:HtmlDocument", "text/html application/xhtml+xml"),
    ("10-ico.rule", "icon", "Pictures", "nfo:Image nfo:Icon", "image/vnd.microsoft.icon"),
    ("10-jpeg.rule", "jpeg", "Pictures", "nfo:Image nmm:Photo", "image/jpeg"),
    ("10-mp3.rule", "mp3", "Audio", "nmm:MusicPiece nfo:Audio", "audio/mpeg audio/x-mp3"),
    ("10-msoffice.rule", "msoffice", "Documents", "nfo:Document", "application/vnd.ms-word application/vnd.ms-word.* application/vnd.ms-powerpoint application/vnd.ms-excel application/vnd.ms-access application/vnd.ms-publisher application/vnd.ms-tnef application/vnd.ms-works application/vnd.ms-wpl application/msword"),
    ("10-oasis.rule", "oasis", "Documents", "nfo:PaginatedTextDocument", "application/vnd.oasis.opendocument.*"),
    ("10-pdf.rule", "pdf", "Documents", "nfo:PaginatedTextDocument", "application/pdf"),
    ("10-png.rule", "png", "Pictures", "nfo:Image nmm:Photo", "image/png sketch/png"),
    ("10-ps.rule", "ps", "Documents", "nfo:PaginatedTextDocument", "application/x-gzpostscript application/postscript"),
    ("10-raw.rule", "raw", "Pictures", "nfo:Image nmm:Photo", "image/x-dcraw image/x-adobe-dng image/x-canon-cr2 image/x-canon-crw image/x-epson-erf image/x-fuji-raf image/x-minolta-mrw image/x-nikon-nef image/x-olympus-orf image/x-panasonic-rw image/x-pentax-pef image/x-raw image/x-samsung-raw image/x-sigma-x3f image/x-sony-arw image/x-sony-srf image/x-sony-sr2"),
    ("10-svg.rule", "", "Pictures", "nfo:Image nfo:VectorImage", "image/svg+xml image/svg+xml-compressed"),
    ("10-tiff.rule", "tiff", "Pictures", "nfo:Image nmm:Photo", "image/tiff"),
    ("10-xps.rule", "xps", "Documents", "nfo:PaginatedTextDocument", "application/oxps application/vnd.ms-xpsdocument"),
    ("11-iso.rule", "iso", "Software", "nfo:FilesystemImage", "application/x-cd-image"),
    ("11-msoffice-xml.rule", "msoffice-xml", "Documents", "nfo:PaginatedTextDocument", "application/vnd.openxmlformats-officedocument.presentationml.presentation application/vnd.openxmlformats-officedocument.presentationml.slideshow application/vnd.openxmlformats-officedocument.spreadsheetml.sheet application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ("15-executable.rule", "", "Software", "nfo:Executable nfo:SoftwareApplication", "application/x-ms-dos-executable"),
    ("15-games.rule", "", "Software", "nfo:GameImage", "application/vnd.nintendo.snes.rom application/x-amiga-disk-format application/x-atari-2600-rom application/x-atari-7800-rom application/x-atari-lynx-rom application/x-dc-rom application/x-doom-wad application/x-fds-disk application/x-gameboy-color-rom application/x-gameboy-rom application/x-gamecube-rom application/x-gamegear-rom application/x-gba-rom application/x-genesis-32x-rom application/x-genesis-rom application/x-n64-rom application/x-neo-geo-pocket-color-rom application/x-neo-geo-pocket-rom application/x-nes-rom application/x-nintendo-ds-rom application/x-pc-engine-rom application/x-saturn-rom application/x-sega-cd-rom application/x-sega-pico-rom application/x-sg1000-rom application/x-sms-rom application/x-virtual-boy-rom application/x-wii-rom application/x-wii-wad application/x-wonderswan-color-rom application/x-wonderswan-rom application/x-msx-rom application/x-nintendo-3ds-rom application/x-nintendo-3ds-executable application/x-discjuggler-cd-image application/x-gd-rom-cue application/x-pc-engine-cd-rom application/x-playstation-rom"),
    ("15-gstreamer-guess.rule", "gstreamer", "Video", "nfo:Media nfo:Video", "video/3gpp video/mp4 video/x-ms-asf application/vnd.ms-asf application/vnd.rn-realmedia"),
    ("15-playlist.rule", "playlist", "Audio", "nmm:Playlist nfo:MediaList", "audio/x-mpegurl audio/mpegurl audio/x-scpls audio/x-pn-realaudio application/ram application/vnd.ms-wpl application/smil audio/x-ms-asx"),
    ("15-text.rule", "text", "Documents", "nfo:Document nfo:PlainTextDocument", "text/plain text/markdown"),
    ("90-disc-generic.rule", "disc-generic", "Software", "nfo:Software", "application/x-cue"),
    ("90-gstreamer-audio-generic.rule", "gstreamer", "Audio", "nfo:Audio", "audio/*"),
    ("90-gstreamer-video-generic.rule", "gstreamer", "Video", "nmm:Video", "video/*"),
    ("90-libav-audio-generic.rule", "libav", "Audio", "nmm:MusicPiece nfo:Audio", "audio/*"),
    ("90-libav-video-generic.rule", "libav", "Video", "nmm:Video", "video/*"),
]
