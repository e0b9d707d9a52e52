"""linewise.sources"""
