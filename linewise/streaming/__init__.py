"""linewise.streaming"""
