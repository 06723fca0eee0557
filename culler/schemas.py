"""Schemas and fixed values of the clean-up planner."""

from __future__ import annotations

ENTRY = "line_no bigint, role string, grp string, id string, parent string, match string, b3 string, size string, w string, h string, name string"
FILE_STATE = "id string, err string, name string, parents array<string>, owned_by_me boolean, capabilities struct<can_remove_children: boolean, can_edit: boolean>, md5 string, size string, trashed boolean, mime_type string, view_link string, created_time string, cur_b3 string"
QUEUE = "line_no bigint, id string, parent string, name string, grp string, owned_by_me boolean, view_link string, created_time string"
LEDGER = "key string, id string, status string, ts timestamp, orphan boolean, parents array<string>"
MEMBERSHIP = "id string, parent string"

# Statuses and the labels that stand for them.
STATUS_LABEL = {
    "removed": "Dikeluarkan dari folder",
    "ready": "Siap dikeluarkan",
    "skip_asli": "DILINDUNGI (file asli)",
    "skip_no_parent_in_report": "Dilewati (laporan tanpa parent)",
    "skip_not_found": "Dilewati (file tidak ada)",
    "skip_trashed": "Dilewati (sudah di sampah)",
    "skip_already_out": "Dilewati (sudah keluar dari folder)",
    "skip_changed_size": "Dilewati (ukuran berubah sejak laporan)",
    "skip_changed_b3": "Dilewati (isi berubah sejak laporan)",
    "skip_unverifiable_need_strict": "Dilewati (tak terverifikasi; pakai --strict)",
    "skip_b3_unavailable": "Dilewati (BLAKE3 tak bisa dihitung)",
    "skip_strict_need_b3": "Dilewati (--strict butuh BLAKE3 di laporan)",
    "skip_no_permission": "Dilewati (tanpa izin mengubah folder)",
    "skip_group_survivor": "Dipertahankan (penjaga grup)",
    "skip_user_keep": "Dipertahankan (pilihan Anda)",
    "skip_multi_parent": "Dilewati (file ada di banyak folder; hindari salah keluar)",
}
# Prefixes of error labels, the address of a file, the stand-in for a missing creation time.
META_FAILED, REMOVE_FAILED = "Gagal baca metadata: ", "Gagal keluarkan: "
VIEW_LINK = ("https://drive.google.com/file/d/", "/view")
NEVER = "9999-12-31T23:59:59.999Z"
# Thresholds of the modes, retry delays in seconds, request rate and burst.
BATCH_FROM, STRICT_ASKS_ABOVE = 5000, 2000
BACKOFF = (1, 2, 4, 8, 16)
ATTEMPTS = 5
RATE, BURST = 9.0, 18.0
