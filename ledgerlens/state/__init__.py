"""Stored state that dashboards read in place of the facts' history: exact mergeable distinct sets and file manifests."""
